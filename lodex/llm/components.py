"""Connected components of a large graph by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodex.llm.support import drop, stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node gets linked to the smallest of its neighbours and itself."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and itself, get linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of an edge (u, v), both long; root is the component's smallest node.

    Links of a node to itself and repeated links change nothing. Each round is written to the shared
    folder, and the edges never leave the executors; the driver only gets their number and a sum.
    """
    now = stage(edges.select("u", "v").where("u <> v").distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        old, before, now = now, state, stage(_small_star(_large_star(now)), "stars")
        drop(old)
    inner = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return inner.unionByName(inner.select(F.col("root").alias("node"), "root").distinct())
