import numpy as np
from test_search import brute_nearest

from lodex.llm import ann


def clustered(n, seed=3, width=32):
    """Groups of about twenty around centres of their own."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 20, width))
    return (centres[rng.integers(0, len(centres), n)] + 0.35 * rng.normal(size=(n, width))).round(4)


def _recall(spark, x):
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    held = ann.usable(df, "vec_id", "embedding")
    setting, _ = ann.choose(held.where("vec_id % 50 = 0"), held)
    got = {(r.query_id, r.vec_id) for r in ann.search(df.where("vec_id % 50 = 0"), df, setting=setting).collect()}
    want = {(q, d) for q, near in brute_nearest(rows).items() for d, _ in near} if len(x) < 5000 else None
    if want is None:
        unit = ann.units(x)
        s = unit[::50] @ unit.T
        s[np.arange(len(s)), np.arange(0, len(x), 50)] = -2
        want = {(50 * q, int(d)) for q, near in enumerate(np.argsort(-s, axis=1)[:, :5]) for d in near}
    reads = 0.0
    for table in range(setting.tables):
        codes, probes = ann.buckets(ann.units(x), table, setting.rotations, 1)[:, 0], ann.buckets(ann.units(x[::50]), table, setting.rotations, setting.probes)
        ordered = np.sort(codes)
        reads += (np.searchsorted(ordered, probes, "right") - np.searchsorted(ordered, probes, "left")).sum() / len(probes)
    return len(got & want) / len(want), reads, setting


def test_work_grows_less_than_the_table(spark):
    """At both sizes nine in ten are found, and ten times the vectors take much less than ten times the comparisons a query."""
    small, few, _ = _recall(spark, clustered(4000))
    large, many, setting = _recall(spark, clustered(40_000))
    assert small >= 0.9 and large >= 0.9, (small, large, setting)
    assert many < 5 * few, (few, many, setting)


def test_queries_of_a_bucket_are_cut_too(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 64)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=4).tolist()) for k in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {(r.query_id, r.rank): r.vec_id for r in ann.search(df.where("vec_id % 50 = 0"), df, setting=ann.Setting(1, 1, 8)).collect()}
    want = {(q, k + 1): d for q, near in brute_nearest(rows).items() for k, (d, _) in enumerate(near)}
    assert got == want  # eight buckets are all there are


def test_tiny_and_huge_components(spark):
    rows = [(0, [1e-200, 2e-200]), (1, [1e-200, 2.1e-200]), (2, [1e200, 2e200]), (3, [-1e200, 1e-200]), (4, [1.0, 0.0]), (50, [1e300, 1e300])]
    got = ann.search(*[spark.createDataFrame(rows, "vec_id long, embedding array<double>")] * 2).collect()
    assert len(got) == 30 and all(-1 - 1e-9 <= r.score <= 1 + 1e-9 for r in got)
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 0][:2] == [2, 1]


def test_many_rows_of_an_id_go_over_all_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 10)
    rows = [(1, [1.0, 0.01 * k]) for k in range(200)] + [(2, [1.0, 0.5]), (3, [0.0, 1.0]), (50, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.rank, r.vec_id) for r in ann.search(df.where("vec_id = 50"), df).collect())
    assert got == [(1, 1), (2, 2), (3, 3)]
