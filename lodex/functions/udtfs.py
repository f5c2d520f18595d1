"""Table functions for SQL: `SELECT ... FROM files, LATERAL symbols_of(path, text)`.

The operators do the same in DataFrames; these are for users who write SQL. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from lodex.config import LANGUAGES, TEXT_LANGUAGES
from lodex.operators import symbols


def _ending(path: str) -> str:
    return path.rpartition(".")[2].lower()


@udtf(returnType="line_no int, line string")
class LinesOf:
    def eval(self, text: str) -> Iterator[tuple]:
        lines = (text or "").split("\n")
        yield from enumerate(lines if lines[-1] else lines[:-1], 1)


@udtf(returnType="idx int, kind string, title string, region string, start_line int, end_line int")
class RegionsOf:
    def eval(self, path: str, text: str) -> Iterator[tuple]:
        yield from symbols.fold_regions(path or "", text or "", LANGUAGES.get(_ending(path or "")) in TEXT_LANGUAGES)


def register(spark: SparkSession) -> None:
    """Make lines_of(text), regions_of(path, text) and symbols_of(path, text) known to SQL; symbols by the extractors registered so far."""
    known = symbols.extractors()

    @udtf(returnType="kind string, name string, qualified_name string, start_line int, end_line int, error string")
    class SymbolsOf:
        def eval(self, path: str, text: str) -> Iterator[tuple]:
            for r in symbols.rows_of(known, path or "", text or ""):
                yield tuple(r.get(c) for c in ("kind", "name", "qualified_name", "start_line", "end_line", "error"))

    for name, function in (("lines_of", LinesOf), ("regions_of", RegionsOf), ("symbols_of", SymbolsOf)):
        spark.udtf.register(name, function)
