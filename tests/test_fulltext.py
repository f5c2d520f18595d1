import random

import pytest
from pyspark.sql import functions as F

from lodex.config import EngineConfig
from lodex.engine import Engine
from lodex.operators import fulltext, retrieval, symbols, views
from lodex.sources.staging import stage
from oracle import difference

WORDS = [f"w{k}" for k in range(30)]


@pytest.fixture(scope="module")
def corpus(spark):
    """Few words are frequent, most are rare, lengths differ; some texts are alike, so scores tie; some are empty or null."""
    rng = random.Random(7)
    texts = [" ".join(rng.choices(WORDS, [1 / (k + 1) ** 1.5 for k in range(30)], k=rng.choice((1, 5, 40, 300)))) for _ in range(400)]
    rows = [(k, texts[k % 350] if k % 41 else ("", None)[k % 2]) for k in range(400)]
    docs = stage(spark.createDataFrame(rows, "doc_id long, text string"), "docs")
    held = stage(retrieval.postings(docs, "doc_id", "text").withColumn("block", F.expr("id div 8")), "held")
    return docs, held, stage(fulltext.packed(held, "block"), "blocks"), retrieval.totals(docs, "text")


@pytest.mark.parametrize(("words", "k"), [(["w0"], 5), (["w0", "w29", "w12", "w29"], 10), (["w28", "w27"], 3), (["w1", "w2", "w3", "w4", "w25"], 60), (["w0", "w1"], 1000), (["w29", "nowhere"], 1), (["nowhere"], 5), ([], 5)])
def test_top_is_the_same_as_by_all_postings(corpus, words, k):
    docs, _, blocks, sums = corpus
    got = [tuple(r) for r in fulltext.top(blocks, sums, words, k, "block").collect()]
    want = [tuple(r) for r in retrieval.bm25(docs, words, "doc_id", "text").orderBy(F.desc("score"), "id").limit(k).collect()] if words else []
    assert got == want
    seen = fulltext.opened(blocks, sums, words, k, "block").first()
    assert 0 <= seen.opened_blocks <= seen.blocks and seen.opened_postings <= seen.postings and (seen.opened_postings >= len(want)) and (seen.opened_blocks > 0) == bool(want)


def test_a_rare_word_keeps_blocks_shut(corpus):
    _, _, blocks, sums = corpus
    seen = fulltext.opened(blocks, sums, ["w0", "w29"], 3, "block").first()
    assert seen.opened_blocks < seen.blocks / 2 and seen.opened_postings < seen.postings / 2


def test_postings_come_back_from_blocks(corpus):
    _, held, blocks, _ = corpus
    rows = lambda df: sorted(map(tuple, df.select("block", "id", "len", "term", "tf").collect()))
    assert rows(fulltext.unpacked(blocks, "block")) == rows(held)


def test_nothing_is_opened_until_a_block_is_wanted(corpus):
    """Bounds are read without what blocks hold."""
    _, _, blocks, sums = corpus
    weighed = fulltext.weights(blocks, sums, ["w0", "w9"])
    plan = fulltext.bounds(blocks, weighed, "block")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<block:bigint,term:string,n:bigint,top_tf:bigint,least_len:int>" in plan and "In(term, [w0,w9])" in plan


def test_a_search_of_nothing(spark):
    none = spark.createDataFrame([], "path string, id string, len int, term string, tf long")
    sums = retrieval.totals(spark.createDataFrame([], "text string"), "text")
    assert fulltext.top(fulltext.packed(none), sums, ["a"], 5).collect() == [] and fulltext.opened(fulltext.packed(none), sums, ["a"], 5).first().blocks == 0


@pytest.mark.parametrize("name", ["fts_bm25_blocks", "fts_blocks_opened"])
def test_against_sql(spark, name):
    from lodex.plans.queries import ORACLE_SQL, QUERIES

    assert difference(spark, "/root/testdata/sf0.01", QUERIES[name], ORACLE_SQL[name]) == ""


def test_an_engine_searches_its_blocks_and_follows_changes(spark, tmp_path):
    root, folder = tmp_path / "tree", str(tmp_path / "store")
    root.mkdir()
    for k in range(12):
        (root / f"m{k}.py").write_text(f"def f{k}():\n    '''Number {k} of the rows{' of apples' * (k % 3)}.'''\n")
    engine = Engine.load_or_build(spark, EngineConfig(str(root), dimensions=8), folder)
    (root / "m3.py").write_text("def g():\n    '''Apples, apples and pears.'''\n")
    (root / "m4.py").unlink()
    engine = engine.refreshed(folder)
    for words in (["apples", "rows"], ["pears"], ["number"]):
        want = retrieval.bm25(engine.records, words, "id", "text").orderBy(F.desc("score"), "id").limit(6).collect()
        assert want and fulltext.top(engine.blocks, engine.totals, words, 6).collect() == want
    assert engine.search("pears", "semantic", 3).where("path = 'm3.py'").count()


def test_previews(spark):
    many = "".join(f"function f{k}(a) {{ return a; }}\n" for k in range(50)) + "class Box {\n  open() { return 1; }\n}\n"
    lines = "\n".join("" if k % 2 else f"line {k}  " for k in range(200))
    rows = [("a.py", '"""Of apples."""\ndef f(x: int) -> int:\n    return x\n'), ("b.js", many), ("c.md", lines), ("d.txt", "x" * 5000), ("e.txt", ""), ("f.js", "let a = 1;\n"), ("g.py", "def f(:\n")]
    files = spark.createDataFrame([(p, t, t.count("\n") + 1) for p, t in rows], "path string, text string, line_count int")
    by_ending = symbols.extractors()
    got = {r.path: r.text for r in views.preview(files, symbols.symbols_of_files(files, by_ending), tuple(by_ending)).collect()}
    assert got["a.py"].startswith("a.py [1fn, 4L]: Of apples.\n  f(x:int)->int") and got["g.py"].startswith("g.py [PARSE ERROR]: ")
    assert got["b.js"].startswith("# b.js  (50 functions, 1 classes)\n## Functions\n- f0  L1-1\n") and "- f39  L40-40\n## Classes\n- Box  L51-53" in got["b.js"] and "f40" not in got["b.js"]
    assert got["c.md"].split("\n") == [f"line {k}" for k in range(0, 80, 2)]
    assert got["d.txt"] == "x" * 4000 + "\n... (truncated)" and got["e.txt"] == "" and got["f.js"] == "# f.js  (0 functions, 0 classes)"
