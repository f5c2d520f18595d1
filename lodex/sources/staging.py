"""Tables that are written once into a folder that driver and executors share, so what reads them twice doesn't make them twice."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. One is set up only where none is named and all run on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodex-"))
        named = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return named


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df once into the shared folder and return the table; lost executors don't lose it.

    The files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/lodex-{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(jsc.hadoopConfiguration()).deleteOnExit(place)
    made = spark.read.schema(df.schema).parquet(path)
    _places[id(made)] = weakref.ref(made), place
    return made


#: Where staged tables are.
_places: dict[int, tuple] = {}


def large(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the files: both sides are sorted.

    Spark goes by the bytes of files, which are few where texts repeat, and would send such a side through the driver to all tasks.
    """
    return df.hint("merge")


#: Rows of a staged table that are sent to all tasks at most.
FEW = 100_000


def few(df: DataFrame) -> DataFrame:
    """A side of a join that is staged and mostly of few rows: it is counted, and sent to all tasks only if it is small."""
    return F.broadcast(df) if df.count() <= FEW else large(df)


def drop(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for made in tables:
        ref, place = _places.pop(id(made), (None, None))
        if ref and ref() is made:
            place.getFileSystem(made.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
