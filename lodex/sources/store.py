"""Tables of an index, kept by path: a base and deltas over it, merged when they are read.

A delta holds the rows of the files that changed, and the paths whose older rows no longer count. What is written for a change is
the size of the change, not of the store. The base is dealt into buckets by a hash of the path. Compaction writes anew the buckets that the deltas
touch, and expiry deletes what no kept version reads. A version counts once its pointer is there, and pointers
are never changed, so readers never see half of one, and one that reads an older version goes on reading it.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodex.config import SCHEMA_VERSION

#: Deltas after which a store is compacted, and the number of buckets of a new one.
MOST_DELTAS, BUCKETS = 32, 8
#: By table, columns by which the base is dealt into folders below its buckets, and columns in whose order its rows are.
FOLDERS = {"records": ("record_type",)}
SORTED = {"postings": ("term",), "grams": ("gram",)}

Tables = dict[str, DataFrame | Callable[[dict[str, DataFrame]], DataFrame]]


class Conflict(RuntimeError):
    """Another version became current meanwhile."""


class Store:
    """Versioned tables below a folder. Those with a column path can be changed by path; others belong to one version alone."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def save(self, tables: Tables, **facts) -> str:
        """Write the tables in order as a new base; one given as a function is made from those already written."""
        part = f"base-{uuid.uuid4().hex}"
        done = self._write(part, tables, self.buckets, {"bucket": self._bucket(self.buckets)})
        return self._point({"buckets": self.buckets, "base": [{"part": part, "buckets": list(range(self.buckets))}], "deltas": [], "tables": list(done), **facts}, None)

    def append(self, tables: Tables, gone: DataFrame, touched: DataFrame | None = None, parent: str | None = None, **facts) -> str:
        """Write a delta over the current version. tables: rows of changed paths. gone: (path) all of whose older rows don't count any more, changed ones among them.

        touched: (path) whose row of the first table alone is replaced. parent: the version that the delta was made for. If another became
        current meanwhile, Conflict is raised.
        """
        meta = self.meta()
        if parent not in (None, meta["version"]):
            raise Conflict(f"{self.folder}: {parent} isn't the current version any more")
        seq, part = len(meta["deltas"]) + 1, f"delta-{uuid.uuid4().hex}"
        marks = gone.select("path", F.lit(False).alias("first_only"))
        if touched is not None:
            marks = marks.unionByName(touched.select("path", F.lit(True).alias("first_only")))
        marks.distinct().withColumn("seq", F.lit(seq)).write.parquet(f"{self.folder}/{part}/gone-paths")
        self._write(part, tables, None, {"seq": F.lit(seq)})
        return self._point(meta | {"deltas": [*meta["deltas"], part], **facts}, meta["version"])

    def compact(self) -> str:
        """The current version with its deltas merged: the buckets that they touch are written anew, the others stay where they are."""
        meta = self.meta()
        if not meta["deltas"]:
            return meta["version"]
        marks = self.spark.read.parquet(*[f"{self.folder}/{d}/gone-paths" for d in meta["deltas"]])
        touched = sorted(r[0] for r in marks.select(self._bucket(meta["buckets"])).distinct().collect())  # at most a row for each bucket
        part = f"base-{uuid.uuid4().hex}"
        merged = {n: self._merged(meta, n, touched) for n in meta["tables"]}
        self._write(part, merged, meta["buckets"], {"bucket": self._bucket(meta["buckets"])})
        kept = [{**b, "buckets": left} for b in meta["base"] if (left := [k for k in b["buckets"] if k not in touched])]
        return self._point(meta | {"base": [*kept, {"part": part, "buckets": touched}], "deltas": []}, meta["version"])

    def expire(self, keep: int = 2, older_than: float = 3600.0) -> int:
        """Forget all versions but the newest, and delete the parts that only those read and that are older than so many seconds. Returns how many parts went.

        Younger parts may be a writer's whose version isn't there yet.
        """
        names = self._pointers()
        if not names:
            return 0
        for name in names[: -max(1, keep)]:
            self._fs.delete(self._path(f"{self.folder}/_meta/{name}"), False)
        used = {p for name in names[-max(1, keep) :] for m in [self._read(name)] for p in (*m["deltas"], *(b["part"] for b in m["base"]))}
        gone = 0
        for status in self._fs.listStatus(self._path(self.folder)):
            name = status.getPath().getName()
            if name.startswith(("base-", "delta-")) and name not in used and status.getModificationTime() < (time.time() - older_than) * 1000:
                gone += bool(self._fs.delete(status.getPath(), True))
        return gone

    def load(self, **facts) -> dict[str, DataFrame] | None:
        """All tables of the current version, or None if there is none or its facts are others."""
        meta = self.meta()
        if meta.get("schema_version") != SCHEMA_VERSION or any(meta.get(k) != v for k, v in facts.items()):
            return None
        return {n: self._merged(meta, n) for n in meta["tables"]}

    def meta(self) -> dict:
        """What the newest pointer says."""
        names = self._pointers()
        return self._read(names[-1]) if names else {}

    def _bucket(self, many: int):
        return F.pmod(F.xxhash64("path"), F.lit(many)).cast("int").alias("bucket")

    def _write(self, part: str, tables: Tables, buckets: int | None, more: dict) -> dict[str, DataFrame]:
        done: dict[str, DataFrame] = {}
        for name, df in tables.items():
            df, place = df(done) if callable(df) else df, f"{self.folder}/{part}/{name}"
            if "path" not in df.columns:
                df.write.parquet(place)
            elif buckets:  # partitions of about the same size, whole buckets where these are small
                (df.withColumns(more).hint("rebalance", "bucket").sortWithinPartitions("bucket", *SORTED.get(name, ())).write.partitionBy("bucket", *FOLDERS.get(name, ())).parquet(place))
            else:
                df.withColumns(more).write.parquet(place)
            done[name] = self.spark.read.schema(df.schema).parquet(place)
        return done

    def _merged(self, meta: dict, name: str, buckets: list[int] | None = None) -> DataFrame:
        """The rows that count: those that no later delta names the path of."""
        parts = [b["part"] for b in meta["base"]]
        first = self.spark.read.parquet(f"{self.folder}/{parts[0]}/{name}")
        if "path" not in first.columns:
            return self.spark.read.parquet(f"{self.folder}/{parts[-1]}/{name}")
        columns = [c for c in first.columns if c != "bucket"]
        live = [(b["part"], [k for k in b["buckets"] if buckets is None or k in buckets]) for b in meta["base"]]
        base = reduce(DataFrame.unionByName, [self.spark.read.schema(first.schema).parquet(f"{self.folder}/{p}/{name}").where(F.col("bucket").isin(k)).select(*columns) for p, k in live if k])
        if not meta["deltas"]:
            return base
        later = self.spark.read.parquet(*[f"{self.folder}/{d}/{name}" for d in meta["deltas"]])
        marks = self.spark.read.parquet(*[f"{self.folder}/{d}/gone-paths" for d in meta["deltas"]])
        if name != meta["tables"][0]:
            marks = marks.where("not first_only")
        last = marks.groupBy(F.col("path").alias("_gone")).agg(F.max("seq").alias("_last"))
        every = base.withColumn("seq", F.lit(0)).unionByName(later.select(*columns, "seq"))
        return every.join(last, F.col("path") == F.col("_gone"), "left").where(F.col("seq") >= F.coalesce("_last", F.lit(0))).select(*columns)

    def _point(self, meta: dict, parent: str | None) -> str:
        """Write a new pointer under another name and rename it, which is done wholly or not at all. parent: the version that must still be current."""
        version, names = uuid.uuid4().hex, self._pointers()
        if parent is not None and (not names or not names[-1].endswith(parent)):
            raise Conflict(f"{self.folder}: {parent} isn't the current version any more")
        made = self._path(f"{self.folder}/_meta/.{version}")
        out = self._fs.create(made)
        out.write(bytearray(json.dumps(meta | {"schema_version": SCHEMA_VERSION, "version": version}).encode()))
        out.close()
        last = int(names[-1].split("-")[0]) if names else 0
        if not self._fs.rename(made, self._path(f"{self.folder}/_meta/{max(last + 1, time.time_ns()):020}-{version}")):
            raise OSError(f"{self.folder}: the new version can't be made current")
        return version

    def _pointers(self) -> list[str]:
        place = self._path(f"{self.folder}/_meta")
        return sorted(n for s in (self._fs.listStatus(place) if self._fs.exists(place) else []) if not (n := s.getPath().getName()).startswith((".", "_")))

    def _read(self, name: str) -> dict:
        return json.loads(self.spark.read.option("wholetext", "true").text(f"{self.folder}/_meta/{name}").first()[0])
