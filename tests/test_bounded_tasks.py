"""What a task holds doesn't grow with the table."""

import math

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from lodex.operators import patterns, retrieval, symbols
from lodex.plans import queries

SF = "/root/testdata/sf0.01"


def _function_of(monkeypatch, files, operator):
    """The function that an operator runs on batches."""
    held = []
    monkeypatch.setattr(type(files), "mapInArrow", lambda self, f, schema: held.append(f) or self)
    operator(files)
    return held[0]


def test_regions_are_handed_on_by_rows_and_characters(spark, monkeypatch):
    files = spark.createDataFrame([("p", "x", "text")], "path string, text string, language string")
    fold = _function_of(monkeypatch, files, lambda df: symbols.regions(df, None, None, None))
    monkeypatch.setattr(symbols, "CHARS", 1000)
    batch = pa.RecordBatch.from_pydict({"path": [f"p{k}" for k in range(40)], "text": ["word " * 40] * 40, "language": ["text"] * 40})
    made = list(fold(iter([batch, batch.slice(0, 0)])))
    assert len(made) >= 6 and sum(len(b) for b in made) == 40 and {p for b in made for p in b.column("path").to_pylist()} == {f"p{k}" for k in range(40)}


def test_runs_of_many_files_are_one_batch(spark, monkeypatch):
    files = spark.createDataFrame([("p", "x")], "path string, text string")
    run = _function_of(monkeypatch, files, patterns.grams)
    texts = ["abcd", None, "", "AbC\nx", "zzzz"] * 20
    made = list(run(iter([pa.RecordBatch.from_pydict({"path": [f"p{k}" for k in range(100)], "text": pa.array(texts, pa.string())})])))
    assert len(made) == 1
    want = sorted((f"p{k}", g) for k, t in enumerate(texts) for g in patterns.codes((t or "").encode()).tolist())
    assert sorted(zip(*made[0].to_pydict().values(), strict=True)) == want
    monkeypatch.setattr(patterns, "RUNS", 10)
    assert len(list(run(iter([pa.RecordBatch.from_pydict({"path": [f"p{k}" for k in range(100)], "text": pa.array(texts, pa.string())})])))) > 5


def test_postings_are_made_in_tasks_of_a_bounded_number_of_words(spark, monkeypatch):
    monkeypatch.setattr(queries, "WORDS", 20_000, raising=False)
    blocks, sums = queries._blocks(spark, SF)
    words = sums.first()
    files = blocks.select(F.input_file_name().alias("f")).distinct().count()
    assert files >= 0.5 * words.n * words.avg_len / 20_000 > 2


def test_a_query_and_a_document_that_share_a_word_are_no_row(spark, monkeypatch):
    """However many blocks there are, the best are those of scoring each pair; ties go by id, and each block hands on k a query."""
    monkeypatch.setattr(retrieval, "DOCUMENTS", 7, raising=False)
    monkeypatch.setattr(retrieval, "QUERIES", 2, raising=False)
    texts = {f"d{k:02}": " ".join(f"w{(k * j) % 11}" for j in range(1 + k % 6)) + " common" for k in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "id string, text string")
    words = [["common"], ["w1", "w2", "w1"], ["w3", "common", "none"], ["absent"], ["w0", "w5", "w7"]]
    asked = spark.createDataFrame(list(enumerate(words)), "query_id long, words array<string>")
    found = retrieval.bm25_many(retrieval.postings(docs, "id", "text"), retrieval.totals(docs, "text"), asked, 4)
    got = [(r.query_id, r.rank, r.id, r.score) for r in found.orderBy("query_id", "rank").collect()]
    held = {i: t.split() for i, t in texts.items()}
    mean, want = sum(map(len, held.values())) / 60, []
    for q, ws in enumerate(words):
        score = {}
        for w in dict.fromkeys(ws):
            df = sum(w in t for t in held.values())
            for i, t in held.items():
                if w in t:
                    score[i] = score.get(i, 0) + math.log(1 + (60 - df + 0.5) / (df + 0.5)) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / mean))
        best = sorted(score, key=lambda i: (-round(score[i], 6), i))[:4]
        want += [(q, n, i, round(score[i], 6)) for n, i in enumerate(best, 1)]
    assert got == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan


def test_regions_of_files_of_any_size(spark, tmp_path):
    """Uncapped regions are those of all documents; capped ones leave out files that are too large."""
    texts = ["a line\n\nb line\n" * 2000, "word " * 120_000 + "\n\n# end\nx", "x\n" * 3001, "short\n\n[x]\ny", "", None]
    rows = [(k, t, "en", "src1") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = queries.regions_uncapped(spark, str(tmp_path))
    want = con.execute(queries.ORACLE_SQL["regions_uncapped"])
    assert got.columns == [c[0] for c in want.description]
    want = sorted(want.fetchall())
    assert sorted(map(tuple, got.collect())) == want and len(want) == 2001 + 2 + 1 + 2
    assert {r.path for r in queries.regions(spark, str(tmp_path)).collect()} == {"src1/en/3.txt"}
