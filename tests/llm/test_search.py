import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lodex.llm import ann, lm, pii
from lodex.llm.queries import QUERIES

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_nearest(vectors, k=5):
    """vectors by id; the k nearest of each id divisible by 50."""
    fine = {d: np.array(v, dtype=float) for d, v in vectors if d is not None and v is not None and None not in v and np.isfinite(np.array(v, dtype=float)).all() and any(v)}
    out = {}
    for q in (d for d in fine if d % 50 == 0):
        near = sorted((-float(fine[q] @ v / (np.linalg.norm(fine[q]) * np.linalg.norm(v))), d) for d, v in fine.items() if d != q and len(v) == len(fine[q]))
        out[q] = [(d, -s) for s, d in near[:k]]
    return out


def test_nearest_small_is_exact(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [2.0, 0.2]), (3, [-1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (None, [1.0, 0.0]), (50, [0.0, 1.0]), (100, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(d, v, 1) for d, v in rows], "vec_id long, embedding array<double>, rank int")
    got = ann.search(df.where("vec_id % 50 = 0"), df).collect()
    want = brute_nearest(rows)
    for q, near in want.items():
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[1] for m in mine] == [d for d, _ in near] and np.allclose([m[2] for m in mine], [s for _, s in near])
    assert ann.search(df.limit(0), df).count() == 0 and ann.search(df, df.limit(0)).count() == 0


def test_equal_vectors_go_by_id_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 50)
    rng = np.random.default_rng(1)
    rows = [(k, [1.0, 2.0, 3.0, 4.0]) for k in range(400)] + [(k, rng.normal(size=4).tolist()) for k in range(400, 600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = ann.search(df.where("vec_id % 50 = 0"), df).where("query_id = 100").orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0, 1, 2, 3, 4] and len({r.score for r in got}) == 1


def test_recall_and_hadamard(spark):
    h = ann.hadamard(np.eye(8))
    assert np.allclose(h @ h.T, np.eye(8))
    sf = "/root/testdata/sf0.1"
    want = brute_nearest([(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()])
    got = {(r.query_id, r.vec_id): r.score for r in QUERIES["op5_cross_polytope_ann"](spark, sf).collect()}
    pairs = {(q, d): s for q, near in want.items() for d, s in near}
    assert len(got) == len(pairs) and len(set(got) & set(pairs)) >= 0.9 * len(pairs)
    assert all(abs(got[p] - pairs[p]) < 1e-12 for p in set(got) & set(pairs))


def brute_scores(docs, corpus, order, alpha, least):
    """corpus: the texts to count, or None: for each text all others."""
    if corpus is None:
        return [brute_scores([t], docs[:k] + docs[k + 1 :], order, alpha, least)[0] for k, t in enumerate(docs)]
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    counts = Counter(tuple(w[k : k + n]) for w in map(split, corpus) for n in range(1, order + 1) for k in range(len(w) - n + 1))
    total = sum(len(split(t)) for t in corpus)

    def one(gram):
        if len(gram) == 1:
            return math.log10(max(counts[gram], 0.5)) - math.log10(max(1, total))
        if counts[gram] >= least:
            return math.log10(counts[gram]) - math.log10(counts[gram[:-1]])
        return math.log10(alpha) + one(gram[1:])

    return [sum(one(tuple(w[max(0, k - order + 1) : k + 1])) for k in range(len(w))) for w in map(split, docs)]


@pytest.mark.parametrize(("order", "least", "own"), [(3, 1, True), (3, 2, True), (2, 1, False), (4, 2, False), (1, 1, True), (4, 1, True)])
def test_backoff_against_brute_force(spark, monkeypatch, order, least, own):
    monkeypatch.setattr(lm, "BLOCK_CHARS", 300)
    monkeypatch.setattr(lm, "PART_GRAMS", 100)
    rng = random.Random(order)
    make = lambda n: [" ".join(rng.choice(("a", "b", "c", "dd", "é", "F")) for _ in range(rng.randrange(20))) for _ in range(n)]
    texts, corpus = [*make(80), None, "", " ", "unseen words here", "a b a b"], make(90)
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, block string").repartition(3)
    other = None if own else spark.createDataFrame([(t,) for t in corpus], "text string")
    rows = {r.doc_id: r for r in lm.score(docs, other, order=order, least=least).collect()}
    want = brute_scores(texts, None if own else corpus, order, 0.4, least)
    assert len(rows) == len(texts)
    for k, w in enumerate(want):
        assert abs(rows[k].log10_score - w) < 1e-9, (k, texts[k])
    assert rows[80].n_words == 0 and rows[80].mean_log10 is None


def test_backoff_of_nothing_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b")], "doc_id long, text string")
    assert len({r.log10_score for r in lm.score(df).collect()}) == 1 and lm.score(df).count() == 3
    assert lm.score(df.limit(0)).count() == 0


def test_packing_of_numbers():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        x = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert (lm.unpacked(lm.packed(x)) == x).all()
    x = np.array([0, 254, 255, 256, 2**64 - 1], dtype=np.uint64)
    assert (lm.unpacked(lm.packed(x)) == x).all() and (lm.unpacked_counts(lm.packed_counts(x[:4].astype(np.int64))) == x[:4]).all()


def brute_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            d = pii.digits_of(m[0])
            if (True, kind == 1 and all(int(p) <= 255 for p in m[0].split(".")), 13 <= len(d) <= 19 and pii.luhn(d), 9 <= len(d) <= 15)[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_against_plain_patterns():
    rng = random.Random(3)
    for _ in range(60_000):
        text = "".join(rng.choice("0123456789 .-@+()aB_\né") for _ in range(rng.randint(0, 40)))
        assert sorted(pii.base_spans(text)) == sorted(brute_spans(text)), text


def test_base_spans_of_long_runs_take_no_time():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "a@" * 50_000, "1." * 100_000, "+1 " * 50_000, "(" * 100_000, "1-" * 100_000):
        pii.redactor().spans(text)


def test_pii_end_to_end(spark):
    docs = [(1, "é mail bob@site.example.com, call 555-123-4567 now"), (2, "host 10.0.0.256 and 10.0.0.25"), (3, "card 4111 1111 1111 1111"), (4, "+1 (988) 555-2485"), (5, None), (6, ""), (7, "on 2021-03-04 version 1.2.3.4567 order 4041894974608796"), (None, "mail bob [at] site [dot] com please")]
    rows = {r.doc_id: r for r in pii.find(spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, spans int")).collect()}
    assert (rows[1].n_email, rows[1].spans, rows[1].redacted) == (1, "email:7:27,phone:34:46", "é mail [email], call [phone] now")
    assert (rows[2].n_ip, rows[2].spans) == (1, "ip:20:29") and rows[3].spans == "card:5:24" and rows[4].n_phone == 1
    assert rows[5].spans == rows[6].spans == rows[7].spans == "" and rows[None].spans == "email:5:28"


def test_trees_are_calibrated_and_precise():
    model = pii.redactor()
    x, y = pii.examples(2000, seed=99)
    p = model.chance(x)
    for kind in range(4):
        of = x[:, 0] == kind
        chosen = p[of] >= model.thresholds[kind]
        assert y[of][chosen].mean() > 0.97 and chosen[y[of] > 0].mean() > 0.9
    assert abs(p.mean() - y.mean()) < 0.05


def test_pii_query_keeps_base_spans(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    for r in QUERIES["op9_pii_boosted"](spark, sf).collect():
        base = sorted(brute_spans(texts[r.doc_id] or ""))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in range(4)]
        assert {pii.told([s]) for s in base} <= set(r.spans.split(","))
