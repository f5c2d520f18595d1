import random

import corpus_pipeline as pipeline

from lodex.llm import near


def brute_roots(texts, at_least=0.8):
    """By number of the text, the smallest number that links of similar texts reach."""
    sets = []
    for t in texts:
        w = (t or "").split()
        sets.append({" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common >= at_least * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((root[a], root[b]))
                root = [x if r == y else r for r in root]
    return root


def planted():
    """Copies with a few edits each, chains of ever more edits, and texts about as similar as the bound."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    texts = [None, "", " ", "a b", "A  b", "a b c"]
    for size in (20, 60, 150, 400) * 10:
        base = [rng.choice(words) for _ in range(size)]
        texts.append(" ".join(base))
        last = base
        for step in range(6):
            last = list(last if step % 2 else base)
            for _ in range(rng.randrange(1, 2 + size // 40)):
                last[rng.randrange(size)] = rng.choice(words)
            texts.append(" ".join(last))
    one = [rng.choice(words) for _ in range(60)]
    for _ in range(150):  # no text of this group need be similar to its least row
        some = list(one)
        for _ in range(2):
            some[rng.randrange(60)] = rng.choice(words)
        texts.append(" ".join(some))
    return texts


def test_stage_against_brute_force(spark, tmp_path):
    texts = planted()
    rng = random.Random(6)
    ids = rng.sample(range(10_000), len(texts))
    path = str(tmp_path / "docs")
    spark.createDataFrame([(d, t, "en", "s", 1) for d, t in zip(ids, texts, strict=True)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(path)
    read = spark.read.parquet(path)
    root = brute_roots([(t or "").lower() for t in texts])
    least = {}
    for d, r in zip(ids, root, strict=True):
        least[r] = min(d, least.get(r, d))
    assert len(least) < len(texts) - 100
    assert sorted(r.doc_id for r in pipeline.drop_near_copies(spark, read, "").collect()) == sorted(least.values())
    rows = near.near_copies(read).collect()
    assert {r.doc_id: r.component_id for r in rows} == {d: least[r] for d, r in zip(ids, root, strict=True)}
