from itertools import combinations

import pytest
from pyspark.sql import functions as F

from lodex.llm import simhash
from lodex.llm.support import join_hot, stage


def brute(texts, radius):
    """fingerprint and smallest doc_id of all that links reach, by all pairs of different fingerprints."""
    fps = {k: simhash.fingerprint((t or "").encode()) for k, t in texts.items()}
    root = {f: f for f in fps.values()}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for f, g in combinations(root, 2):
        if (f ^ g).bit_count() <= radius:
            root[top(f)] = top(g)
    best = {}
    for k in sorted(fps):
        best.setdefault(top(fps[k]), k)
    return {k: (f"{f:016x}", best[top(f)]) for k, f in fps.items()}


@pytest.mark.parametrize("nothing", ["", "one text that half of the rows are copies of"])
def test_a_fingerprint_on_half_the_rows(spark, nothing):
    texts = {k: (nothing or (None, "", " \t")[k % 3]) if k % 2 else f"word{k % 700} and {k % 11} more of it {k % 3}" for k in range(3000)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert {k: (r.fingerprint, r.component_id) for k, r in got.items()} == brute(texts, 2)
    assert sum(r.kept for r in got.values()) == len({r.component_id for r in got.values()}) and all(r.kept == (k == r.component_id) for k, r in got.items())


def test_hot_keys_come_by_broadcast_and_no_row_is_lost_or_doubled(spark):
    rows = stage(spark.range(20000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5000).alias("key")), "rows")
    facts = stage(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("least")), "facts")
    got = join_hot(rows, facts, "key", "n", 20000)
    assert got.count() == 20000 and got.select("id").distinct().count() == 20000
    assert got.exceptAll(rows.join(facts, "key").select(*got.columns)).isEmpty()
    assert facts.where("n > 20").count() == 1 and "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()


def test_no_rows(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
