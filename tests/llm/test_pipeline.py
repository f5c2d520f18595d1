from collections import Counter

import corpus_pipeline as pipeline
from test_near import brute_roots

from lodex.llm import exact, mixing

SF = "/root/testdata/sf0.01"


def test_stages_follow_from_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, kept[-1], SF)
        assert out.columns == docs.columns, name
        kept.append(spark.createDataFrame(out.collect(), docs.schema))
    ids = [[r.doc_id for r in k.select("doc_id").collect()] for k in kept]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sum(labels.get(d) == 1 for d in ids[1]) >= 0.98 * sum(q == 1 for q in labels.values())
    assert sum(labels.get(d) == 0 for d in ids[1]) <= 0.05 * sum(q == 0 for q in labels.values())
    assert sorted(ids[2]) == sorted(r.doc_id for r in exact.deduplicate(kept[1]).where("kept").collect())
    texts = [" ".join(r.text.split()) for r in kept[2].collect()]
    assert len(texts) == len(set(texts))
    # the near-copy stage's rule: five-word shingles, similar by 0.8 or more, links followed; the smallest id stays
    rows = sorted(kept[2].collect(), key=lambda r: r.doc_id)
    assert len({r.doc_id for r in rows}) == len(rows)
    root = brute_roots([r.text.lower() for r in rows])
    assert sorted(ids[3]) == [r.doc_id for k, r in enumerate(rows) if root[k] == k]
    times = {r.doc_id: r.times for r in mixing.mix(kept[3]).collect()}
    assert Counter(ids[4]) == {d: n for d, n in times.items() if n}
    packed = pipeline.pack_sequences(spark, kept[4], SF).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(ids[4])
    rows = Counter((r.doc_id, r.piece, r.ids_crc32) for r in packed)
    assert rows == Counter((r.doc_id, r.piece, r.ids_crc32) for r in pipeline.run(spark, SF).collect())


def test_stages_of_no_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_stages_of_odd_rows(spark, tmp_path):
    """Nulls in any column, repeated rows, one id for two texts, very long and empty texts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()
    long = "some long text " * 30_000
    odd = [(1007, "twice the same", "en", "s", 1)] * 2 + [(None, "no id", None, None, None), (None, None, None, None, None), (None, "", "en", None, 0), (1008, "one id", "en", "s", 1), (1008, "two texts", "en", "s", 1), (9, long, "en", "s", 1), (10, long + " ", "en", "s", 1)]
    path = str(tmp_path / "docs")
    spark.createDataFrame([tuple(r) for r in docs] + odd, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path)
    read = spark.read.parquet(path)
    exactly = pipeline.drop_copies(spark, read, SF).collect()
    texts = [exact.normalised((r.text or "").encode()) for r in exactly]
    assert len(texts) == len(set(texts)) == len({exact.normalised((r.text or "").encode()) for r in read.collect()})
    assert sum(r.doc_id == 1008 for r in exactly) == 2 and sum(r.doc_id == 1007 for r in exactly) == 1
    near = pipeline.drop_near_copies(spark, read, SF).collect()
    assert brute_roots([(r.text or "").lower() for r in near]) == list(range(len(near)))
    assert len(near) == len(set(brute_roots([(r.text or "").lower() for r in read.collect()])))
    for _, stage in pipeline.STAGES[:1] + pipeline.STAGES[3:]:
        assert stage(spark, read, SF).count()
    assert sum(r.piece == 0 for r in pipeline.pack_sequences(spark, read, SF).collect()) == read.count()
