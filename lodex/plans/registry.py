"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as a query, with its SQL if SQL can say the same."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


#: Rows of a table that one task writes out as files of code.
FILES_A_TASK = 4000


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows of which files are written, dealt by key over tasks of a few thousand each: they are small, and what is made of them is not."""
    return rows.repartition(-(-rows.count() // FILES_A_TASK) or 1, key)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
