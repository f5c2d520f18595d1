"""Keeping tables fresh: differences of listings, upserts, deletions, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, status of two listings (path, mtime, content_hash): added, deleted, modified, touched (mtime alone), unchanged."""
    o, n = old.select("path", F.col("mtime").alias("o_mtime"), F.col("content_hash").alias("o_hash")), new.select("path", F.col("mtime").alias("n_mtime"), F.col("content_hash").alias("n_hash"))
    status = F.when(F.col("o_hash").isNull(), "added").when(F.col("n_hash").isNull(), "deleted").when(F.col("o_hash") != F.col("n_hash"), "modified").when(F.col("o_mtime") != F.col("n_mtime"), "touched").otherwise("unchanged")
    return o.join(n, "path", "full").select("path", status.alias("status"))


def upsert(base: DataFrame, changed: DataFrame, key: str = "path") -> DataFrame:
    """All rows of a changed key replaced by the new ones."""
    return base.join(changed.select(key).distinct(), key, "left_anti").unionByName(changed)


def remove(base: DataFrame, gone: DataFrame, key: str = "path") -> DataFrame:
    """Rows whose key isn't among those gone."""
    return base.join(gone.select(key).distinct(), key, "left_anti")


def really_changed(changed: DataFrame, indexed: DataFrame) -> DataFrame:
    """Changed files whose content isn't what the index has already."""
    return changed.join(indexed.select("path", "content_hash"), ["path", "content_hash"], "left_anti")


def additive_copy(target: DataFrame, source: DataFrame, tombstones: DataFrame, key: str = "path") -> DataFrame:
    """The source's rows over the target's; rows that only the target has stay, tombstones go."""
    return remove(upsert(target, source, key), tombstones, key)


def verify(source: DataFrame, copy: DataFrame) -> DataFrame:
    """path, result: OK if the copy has the same content, else FAIL."""
    right = copy.select("path", F.col("content_hash").alias("there"))
    return source.join(right, "path", "left").select("path", F.when(F.col("content_hash") == F.col("there"), "OK").otherwise("FAIL").alias("result"))


def last_op(events: DataFrame, gap: str) -> DataFrame:
    """path, begin, op, events of bursts: events of a path closer than the gap are one, and its last one counts."""
    burst = events.groupBy("path", F.session_window("ts", gap).alias("w"))
    return burst.agg(F.max_by("op", F.struct("ts", "seq")).alias("op"), F.count("*").alias("events")).select("path", F.col("w.start").alias("begin"), "op", "events")
