import random
import re
from collections import defaultdict

import numpy as np
import pytest

from lodex.llm import mixing


def brute_targets(sizes):
    """Deal the excess again and again."""
    weights, caps = [(3, 1, 2)[k % 3] for k in range(len(sizes))], [2 * s for s in sizes]
    out, left = [0.0] * len(sizes), 1.5 * sum(sizes)
    while left > 1e-9:
        free = [k for k in range(len(sizes)) if out[k] < caps[k] - 1e-12]
        if not free:
            break
        share = left / sum(weights[k] for k in free)
        for k in free:
            out[k] += share * weights[k]
        left = sum(max(0, out[k] - caps[k]) for k in free)
        out = [min(o, c) for o, c in zip(out, caps, strict=True)]
    return out


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1000, 1, 1, 1], [1, 5000, 7], [0, 3, 0, 9], [5], []])
def test_targets(sizes):
    got = mixing.targets(sizes)
    assert np.allclose(got, brute_targets(sizes))
    assert all(g <= 2 * s + 1e-9 for g, s in zip(got, sizes, strict=True))


def test_flight_keeps_both_sums_and_chances():
    rng = np.random.default_rng(1)
    size = rng.integers(1, 500, 300).astype(float)
    hits = np.zeros(300)
    for seed in range(300):
        out = mixing.flight(np.full(300, 0.3), np.column_stack([size, np.ones(300)]), np.random.default_rng(seed))
        assert ((out > 0) & (out < 1)).sum() <= 2
        assert np.isclose(out @ size, 0.3 * size.sum()) and np.isclose(out.sum(), 90)
        hits += out
    assert abs(hits.mean() / 300 - 0.3) < 1e-6 and abs(hits / 300 - 0.3).max() < 0.12


@pytest.mark.parametrize("block", [8192, 16])
def test_mix_hits_its_targets(spark, monkeypatch, block):
    """With tiny blocks there are several rounds of flights."""
    monkeypatch.setattr(mixing, "BLOCK", block)
    rng = random.Random(5)
    docs = [(k, "w " * rng.randrange(60), rng.choice(["a"] * 6 + ["b", "é", "c", None]), "x") for k in range(1500)] + [(1500, None, "a", "x"), (1501, "", None, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, size string").repartition(4)
    rows = {r.doc_id: r for r in mixing.mix(df).collect()}
    again = {r.doc_id: r.taken for r in mixing.mix(df.repartition(7)).collect()}
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, _, _ in docs}
    by = defaultdict(int)
    for d, _, s, _ in docs:
        by[s] += size[d]
    order = sorted(by, key=lambda s: (s is None, s or ""))
    aim = dict(zip(order, brute_targets([by[s] for s in order]), strict=True))
    taken = defaultdict(int)
    for d, _, s, _ in docs:
        r = rows[d]
        assert r.size == size[d] and r.source_size == by[s] and abs(r.target - aim[s]) < 1e-6
        assert r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
    assert len(rows) == len(docs) and {d: r.taken for d, r in rows.items()} == again
    for s in order:
        assert abs(taken[s] - aim[s]) <= 0.01 * aim[s] + 30


def test_mix_of_nothing_and_without_words(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in mixing.mix(df).collect()] == [(0, 0), (0, 0)]
    assert mixing.mix(df.limit(0)).count() == 0
