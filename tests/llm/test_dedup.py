import hashlib
import random
import re
from collections import defaultdict

import pytest
import xxhash
from oracle import difference

from lodex.llm import components, exact, simhash
from lodex.llm.queries import ORACLE_SQL, QUERIES

EDGES = [None, "", " ", "\t\n", "a", " a", "a ", "a  b", "a b", "x" * 20_000, "word " * 5000, "word\n" * 5000]


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("text", [t for t in EDGES if t is not None])
def test_normalised(text):
    assert exact.normalised(text.encode()).decode() == normal(text)


def test_chunks_make_the_text_and_follow_content():
    rng = random.Random(1)
    text = bytes(rng.randrange(256) for _ in range(60_000))
    parts = exact.chunks(text)
    assert b"".join(parts) == text and all(len(p) <= exact.MOST for p in parts)
    moved = exact.chunks(b"a few bytes more " + text)
    assert len(set(parts) & set(moved)) >= len(parts) - 4


@pytest.mark.parametrize("id_bytes", [1, 16])
def test_exact_against_brute_force(spark, id_bytes):
    """With identifiers of one byte different chunks do meet, and longer ones are taken."""
    rng = random.Random(2)
    texts = EDGES + [" ".join(rng.choice("ab") for _ in range(rng.randrange(6))) for _ in range(300)] + ["common passage " * 200 + str(k % 3) for k in range(9)]
    docs = [(k * 3, t, f"kept{k}") for k, t in enumerate(texts)]
    rows = exact.deduplicate(spark.createDataFrame(docs, "doc_id long, text string, kept string").repartition(5), id_bytes=id_bytes).collect()
    groups = defaultdict(list)
    for d, t, _ in docs:
        groups[normal(t)].append(d)
    assert len(rows) == len(docs)
    by = {r.doc_id: r for r in rows}
    for d, t, _ in docs:
        g = groups[normal(t)]
        assert (by[d].keep_id, by[d].group_size, by[d].kept, by[d].text_sha256) == (min(g), len(g), d == min(g), hashlib.sha256(normal(t).encode()).hexdigest())


def test_exact_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a"), (2, "a"), (2, "a"), (None, "b"), (None, "b")], "doc_id long, text string")
    rows = exact.deduplicate(df).collect()
    assert sorted((r.keep_id or 0, r.group_size, r.kept) for r in rows) == [(0, 2, False), (0, 2, True), (2, 3, False), (2, 3, False), (2, 3, True)]
    assert exact.deduplicate(df.limit(0)).count() == 0


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """fps by id; the smallest id reachable over links of at most two bits."""
    root = {d: d for d in fps}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(fps)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 2 and (x := top(a)) != (y := top(b)):
                root[max(x, y)] = min(x, y)
    return {d: top(d) for d in ids}


def test_simhash_against_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(50)] + ["ÄÖ", "Été", "ẞ"]
    base = [[rng.choice(words) for _ in range(rng.choice((1, 2, 3, 5, 400)))] for _ in range(60)]
    texts = [" ".join(b) for b in base]
    for b in base[:40]:
        for _ in range(3):
            c = list(b)
            c[rng.randrange(len(c))] = rng.choice(words)
            texts.append(" ".join(c).upper() if rng.random() < 0.2 and all(w.isascii() for w in c) else " ".join(c))
    texts += EDGES
    docs = [(k * 2 + 1, t) for k, t in enumerate(texts)]
    rows = simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    fps = {d: brute_fingerprint(t) for d, t in docs}
    want = brute_components(fps)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {d: (f"{fps[d]:016x}", want[d]) for d in fps}
    assert len(set(want.values())) < len(set(fps.values()))


def test_links_lose_nothing(spark):
    """Chains and balls of fingerprints, also at the sign bit."""
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    fps = {centre ^ (1 << b) for b in range(64)} | {centre ^ 7, 0, 1, 1 << 63, 3 << 62}
    chain = rng.getrandbits(64)
    for b in range(0, 40, 2):
        chain ^= 3 << b
        fps.add(chain)
    fps |= {rng.getrandbits(64) for _ in range(200)}
    signed = {f - (1 << 64) if f >> 63 else f: f for f in fps}
    found = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), 2)
    roots = {r.node: r.root for r in components.components(found).collect()}
    want = brute_components({f: f for f in fps})
    for a, fa in signed.items():
        for b, fb in signed.items():
            assert (want[fa] == want[fb]) == (roots.get(a, a) == roots.get(b, b))


def test_near_duplicates_of_nothing_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a"), (5, "a"), (5, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(df).collect()) == [(0, 5), (5, 5), (5, 5)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_with_sql(spark, name):
    assert not difference(spark, "/root/testdata/sf0.01", QUERIES[name], ORACLE_SQL[name])
