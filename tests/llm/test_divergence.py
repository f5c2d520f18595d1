import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodex.llm import divergence


def by_hand(rows, least, top):
    """The same by plain Python over all rows."""
    terms = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows]
    seen = Counter((lang, t) for lang, _, ts in terms for t in set(ts))
    counts = defaultdict(Counter)
    for lang, source, ts in terms:
        counts[lang, source].update(t for t in ts if seen[lang, t] >= least)
    out = set()
    for lang in {g[0] for g in counts}:
        kept = sorted((t for x, t in seen if x == lang and seen[x, t] >= least), key=str.encode)
        groups = {s: c for (x, s), c in counts.items() if x == lang}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in groups.items()}, share(sum(groups.values(), Counter()))
        for s in groups:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in groups if o != s]
            over = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", over, top)):
                for k, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]):
                    out.add((lang, s, part, item, value, k + 1))
    return out


@pytest.mark.parametrize("cells", [1 << 20, 8])
def test_audit_is_what_brute_force_finds(spark, monkeypatch, cells):
    """Nulls, empty and long texts, ties, repeated rows, groups and languages without terms; one chunk, and many."""
    monkeypatch.setattr(divergence, "CELLS", cells)
    monkeypatch.setattr(divergence, "LEAST_TERMS", min(cells, 256))
    rng = np.random.default_rng(3)
    words = ["Ab", "ab", "cd", "éÉ", "日本", "zz", "z", "x'y", "q1q", "_u_", "🙂", "ǅ"]
    rows = [(" ".join(rng.choice(words, rng.integers(0, 12))), str(rng.choice(["en", "fr"])), f"s{rng.integers(0, 4)}") for _ in range(80)]
    rows += [(None, "en", "s9"), ("", None, None), ("ab ab", None, "s1"), ("only here", "de", "one"), ("cd " * 40_000, "en", "s0"), (None, "xx", "a"), (None, "xx", "b"), *[("rep zz", "fr", "s1")] * 4]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "text string, lang string, source string, term string").repartition(3)
    got = [tuple(r) for r in divergence.audit(docs, 3, 3).collect()]
    assert len(got) == len(set(got)) and set(got) == by_hand(rows, 3, 3)


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_shares_are_exact():
    rng = np.random.default_rng(0)
    total = rng.integers(1, 9 * 10**15, 2000)
    counts = np.minimum(total, (total * rng.random(2000) ** 8).astype(np.int64) + 1)
    assert divergence.per_billion(counts, total).tolist() == [1 + 10**9 * c // t for c, t in zip(counts.tolist(), total.tolist(), strict=True)]
