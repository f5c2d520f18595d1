import math
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodex.config import EngineConfig, resolve_root
from lodex.engine import Engine
from lodex.functions import paths, text, udtfs, vectors
from lodex.operators import freshness, graph, retrieval, scanner, symbols
from lodex.sources.files import Store, env_pairs, fingerprint, scan, walk
from lodex.streaming import watch


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("pattern", "path", "hit"), [("*.py", "a.py", True), ("*.py", "b/a.py", False), ("**/*.py", "a.py", True), ("**/*.py", "x/y/a.py", True), ("src/**", "src/a/b", True), ("src/**", "srcs/a", False), ("a?.[ch]", "ab.c", True), ("a[!b].c", "ab.c", False), ("/lib/*", "lib/x", True), (".*", ".env", True)])
def test_globs(spark, pattern, path, hit):
    assert one(spark, F.lit(path).rlike(paths.glob_regex(pattern))) == hit


RULES = ["# comment", "", "*.log", "!keep.log", "/build/", "docs/*.tmp", "cache/"]


@pytest.mark.parametrize(("path", "gone"), [("a.log", True), ("x/a.log", True), ("x/keep.log", False), ("build/a", True), ("x/build/a", False), ("docs/a.tmp", True), ("docs/x/a.tmp", False), ("x/cache/f", True), ("cachet/f", False), ("build", False)])
def test_ignore_rules_last_match_decides(spark, path, gone):
    assert one(spark, paths.ignored(F.lit(path), RULES)) == gone


@pytest.mark.parametrize(("path", "strict", "substring"), [("src/out/a.py", True, True), ("src/layout/a.py", False, True), ("a/robin/b.py", False, True), ("a/b.py", False, False), ("x.egg-info/a.py", False, True)])
def test_excluded_names(spark, path, strict, substring):
    assert one(spark, paths.excluded(F.lit(path))) == strict and one(spark, paths.excluded(F.lit(path), substring=True)) == substring


@pytest.mark.parametrize(("path", "language"), [("a.PY", "python"), ("a.h", "c-family"), ("a.zig", "zig"), ("Makefile", "unknown"), ("a/b.d/c", "unknown")])
def test_languages(spark, path, language):
    assert one(spark, paths.language(F.lit(path))) == language


@pytest.mark.parametrize(("body", "lines", "count"), [("", [], 0), ("a", ["a"], 1), ("a\n", ["a"], 2), ("a\n\nb", ["a", "", "b"], 3), ("\n", [""], 2)])
def test_lines(spark, body, lines, count):
    assert one(spark, text.lines_of(F.lit(body))) == lines and one(spark, text.line_count(F.lit(body))) == count


@pytest.mark.parametrize(("name", "kind"), [("x", "public"), ("_x", "protected"), ("__x", "private"), ("__x__", "public"), ("__x_", "private")])
def test_visibility(spark, name, kind):
    assert one(spark, text.visibility(F.lit(name))) == kind


def brute_regions(lines):
    """Line numbers of chunks, for texts in which no limit binds: runs without blank lines, cut before headings."""
    out, held = [], []
    for n, line in enumerate(lines, 1):
        if held and (not line.strip() or line.startswith("#")):
            out.append(held)
            held = []
        if line.strip():
            held.append(n)
    return [(h[0], h[-1]) for h in out + [held] * bool(held)]


def test_regions_against_plain_runs():
    rng = random.Random(1)
    for _ in range(300):
        lines = [rng.choice(["some prose here", "x = 1;", "", "# head", "  "]) for _ in range(rng.randrange(25))]
        made = symbols.fold_regions("p", "\n".join(lines), False)
        assert [(r[4], r[5]) for r in made] == brute_regions(lines)
        assert all(r[3] and "\n\n" not in r[3] for r in made)


def test_region_limits():
    assert [r[5] - r[4] + 1 for r in symbols.fold_regions("p", "\n".join(["word"] * 100), True)] == [40, 40, 20]
    assert len(symbols.fold_regions("p", "\n\n".join(["word"] * 500), True)) == 200
    assert max(len(r[3]) for r in symbols.fold_regions("p", "\n".join(["y" * 700] * 10), True)) <= 1800
    assert symbols.fold_regions("p", "z" * 200, False)[0][2] == "z" * 117 + "..."


SAMPLE = '''"""Sample module.

More."""
from __future__ import annotations
import os.path as osp
from helper import target as alias, other
from typing import Protocol
from dataclasses import dataclass
MAX: int = 3
lower = 1

def plain(a, b: int = 2, *args, key=None, **kw) -> str:
    """First line.

    Rest."""
    if a:
        raise ValueError("x")
    alias(a); alias(b)
    return helper.deep(other(a))

async def later():
    yield 1

def __hidden(): ...
def _shy(): ...

@dataclass
class Point:
    x: int
    y: int = 0

class Shape(Protocol):
    def area(self) -> float: ...

class Box:
    store: Point
    def __init__(self, n: int):
        self.n: int = n
        self.items = []
    @property
    def size(self): return self.grow()
    def grow(self): return self.store.area()

type Pair = tuple[int, int]
def plain2(): return plain(1)
'''


def rows_of(source, path="m.py"):
    return {(r["kind"], r.get("qualified_name") or r.get("name") or r.get("module")): r for r in symbols.parse_python(path, source)}


def test_python_parse():
    r = rows_of(SAMPLE)
    f = r["function", "plain"]
    assert [p["name"] for p in f["params"]] == ["a", "b", "args", "key", "kw"] and f["params"][1]["default_value"] == "2" and f["params"][2]["variadic"] and f["params"][4]["kw_variadic"]
    assert f["return_type"] == "str" and f["doc_first"] == "First line." and f["raises"] == ["ValueError"]
    assert {c["callee"]: c["n"] for c in f["calls"]} == {"ValueError": 1, "alias": 2, "helper.deep": 1, "other": 1}
    assert r["function", "later"]["is_async"] and r["function", "later"]["is_generator"]
    assert r["function", "__hidden"]["visibility"] == "private" and r["function", "_shy"]["visibility"] == "protected"
    assert [a["name"] for a in r["class", "Point"]["instance_attrs"]] == ["x", "y"] and r["class", "Point"]["class_attrs"] == []
    assert [a["name"] for a in r["class", "Box"]["instance_attrs"]] == ["n", "items"] and r["method", "Box.size"]["is_property"]
    assert r["constant", "MAX"]["value"] == "3" and ("constant", "lower") not in r and r["type_alias", "Pair"]["value"] == "tuple[int, int]"
    assert r["module", "m.py"]["doc_first"] == "Sample module."
    imports = [(x["module"], x["names"], x["alias"]) for x in symbols.parse_python("m.py", SAMPLE) if x["kind"].startswith("import")]
    assert ("helper", ["other"], None) in imports and ("helper", ["target"], "alias") in imports and ("os.path", [], "osp") in imports


def test_broken_python_is_a_row():
    row, spot = symbols.parse_python("b.py", "def f(:\n")
    assert (spot["kind"], spot["name"], spot["start_line"]) == ("function", "f", 1)
    assert row["kind"] == "error" and "syntax error at L1" in row["error"]
    twice = [r for r in symbols.parse_python("t.py", "def f(): return 1\ndef f(a): return 2\n") if r["kind"] == "function"]
    assert [len(r["params"]) for r in twice] == [1]


PROJECT = {
    "helper.py": "def target(): pass\ndef twin(): pass\ndef lone(): pass\n",
    "other.py": "def twin(): pass\ndef same(): pass\nclass T:\n    def act(self): pass\n    def go(self): self.act()\nclass U:\n    t: T\n    def act(self): pass\n    def run(self): self.t.act()\n",
    "main.py": "from helper import target as t, twin\nimport helper\ndef same(): pass\ndef run():\n    t(); twin(); helper.twin(); same(); lone(); missing(); requests.lone()\n",
    "far.py": "import unknown\ndef f():\n    twin(); unknown.twin()\n",
}


def resolved(spark):
    files = spark.createDataFrame(list(PROJECT.items()), "path string, text string")
    return graph.resolve_calls(symbols.python_symbols(files))


def test_call_resolution_by_priority(spark):
    got = {(r.caller, r.callee): (r.to_path, r.to_name, r.confidence, r.is_external, r.match_count) for r in resolved(spark).collect()}
    assert got["run", "t"] == ("helper.py", "target", "exact", False, 1)
    assert got["run", "twin"] == ("helper.py", "twin", "preferred", False, 2)
    assert got["run", "helper.twin"] == ("helper.py", "twin", "preferred", False, 2)
    assert got["run", "same"] == ("main.py", "same", "preferred", False, 2)
    assert got["run", "lone"][:3] == got["run", "requests.lone"][:3] == ("helper.py", "lone", "exact")
    assert got["run", "missing"] == (None, None, "exact", True, 0)
    assert got["T.go", "self.act"] == ("other.py", "T.act", "exact", False, 2)
    assert got["U.run", "self.t.act"] == ("other.py", "T.act", "exact", False, 2)
    assert got["f", "twin"][2] == "ambiguous" and got["f", "unknown.twin"][2] == "preferred"


def test_callers_and_traces(spark):
    calls = resolved(spark)
    back = {(r.to_path, r.to_name): sorted(x.caller for x in [r]) for r in graph.callers(calls).collect()}
    assert back["helper.py", "target"] == ["run"]
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("b", "a"), ("a", "c")], "src string, dst string")
    root = spark.createDataFrame([("a",)], "node string")
    assert {r.node: r.depth for r in graph.trace(edges, root, 9).collect()} == {"b": 1, "c": 1, "d": 2, "e": 3}
    assert {r.node for r in graph.trace(edges, root, 0).collect()} == {"b", "c"}
    assert {r.callee for r in graph.ambiguities(calls).where("path = 'far.py'").collect()} == {"twin", "unknown.twin"}
    assert "ambiguous" not in {r.confidence for r in graph.confident(calls).collect()}


def test_rrf_by_hand_and_any_order(spark):
    vec, fts = [(5, 0), (7, 1), (9, 2)], [(9, 0), (5, 1), (4, 2)]
    want = {i: sum(1 / (60 + r) for x in (vec, fts) for j, r in x if j == i) for i in (4, 5, 7, 9)}
    for flip in (1, -1):
        got = retrieval.rrf(spark.createDataFrame(vec[::flip], "id long, rank int"), spark.createDataFrame(fts[::flip], "id long, rank int")).orderBy(*retrieval.fused_order()).collect()
        assert [r.id for r in got] == [5, 9, 7, 4] and all(math.isclose(r.score, want[r.id], abs_tol=1e-9) for r in got)


def test_failing_reranker_leaves_the_order(spark):
    vec, fts = spark.createDataFrame([(1, 0.1), (2, 0.2)], "id long, distance double"), spark.createDataFrame([(2, 5.0)], "id long, score double")

    def broken(df):
        raise RuntimeError("no model")

    assert [r.id for r in retrieval.hybrid(vec, fts, 5, broken).collect()] == [r.id for r in retrieval.hybrid(vec, fts, 5).collect()] == [2, 1]
    assert [r.id for r in retrieval.hybrid(vec, fts, 5, lambda df: df.orderBy("id")).collect()] == [1, 2]


def test_bm25_by_hand(spark):
    docs = [(1, "a a b"), (2, "b c"), (3, "c c c c"), (4, "")]
    got = {r.id: r.score for r in retrieval.bm25(spark.createDataFrame(docs, "id long, text string"), ["a", "c", "a"], "id", "text").collect()}
    words = {d: t.split() for d, t in docs}
    mean = sum(map(len, words.values())) / 4
    idf = lambda t: math.log(1 + (4 - (d := sum(t in w for w in words.values())) + 0.5) / (d + 0.5))
    want = {d: sum(idf(t) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in ("a", "c") if t in w) for d, w in words.items()}
    assert got == {d: round(s, 6) for d, s in want.items() if s}


def test_vectors(spark):
    v = one(spark, vectors.truncated(vectors.literal([3, 4, 9]), 2))
    assert np.allclose(v, [0.6, 0.8]) and one(spark, vectors.truncated(vectors.literal([0, 0]), 2)) == [0, 0]
    assert math.isclose(one(spark, vectors.cosine(vectors.literal([1, 2]), vectors.literal([2, 4]))), 1)
    assert math.isclose(np.linalg.norm(vectors.hash_embedding("some words", 64)), 1) and not vectors.hash_embedding("", 8).any()


def test_bad_patterns_and_places(spark):
    with pytest.raises(ValueError, match="invalid regular expression"):
        retrieval.checked("(")
    assert retrieval.checked("a", case_sensitive=True) == "a"


def test_freshness_is_a_rebuild(spark):
    rng = random.Random(4)
    for _ in range(3):
        old = {f"p{k}": rng.randrange(5) for k in rng.sample(range(20), 12)}
        new = {f"p{k}": rng.randrange(5) for k in rng.sample(range(20), 12)}
        df = lambda d: spark.createDataFrame([(p, 1, str(h)) for p, h in d.items()], "path string, mtime int, content_hash string")
        diff = {r.path: r.status for r in freshness.snapshot_diff(df(old), df(new)).collect()}
        gone = spark.createDataFrame([(p,) for p, s in diff.items() if s == "deleted"], "path string")
        changed = df({p: h for p, h in new.items() if diff[p] in ("added", "modified")})
        made = freshness.upsert(freshness.remove(df(old), gone), changed)
        assert {r.path: r.content_hash for r in made.collect()} == {p: str(h) for p, h in new.items()}
    a, b = df({"x": 1, "y": 2}), df({"y": 2, "x": 1})
    assert fingerprint(a, "path", "content_hash").first() == fingerprint(b, "path", "content_hash").first() != fingerprint(df({"x": 1, "y": 3}), "path", "content_hash").first()


def test_debounce_last_operation_counts(spark):
    raw = spark.createDataFrame([("modified", "a", None, 0.0, 1), ("deleted", "a", None, 0.1, 2), ("deleted", "b", None, 0.0, 3), ("created", "b", None, 0.0, 4), ("moved", "c", "d", 0.0, 5), ("modified", "a", None, 9.0, 6)], "kind string, path string, dest string, s double, seq long").withColumn("ts", F.timestamp_millis((F.col("s") * 1000).cast("long"))).withColumn("is_dir", F.lit(False))
    got = sorted((r.path, r.op, r.events) for r in watch.debounced(watch.normalised_events(raw)).collect())
    assert got == [("a", "change", 1), ("a", "delete", 2), ("b", "change", 2), ("c", "delete", 1), ("d", "change", 1)]


def test_stream_applies_deletes_before_changes(spark, tmp_path):
    events = spark.createDataFrame([("a", "delete", 1), ("b", "change", 1), ("b", "delete", 2), ("c", "delete", 1), ("c", "change", 2)], "path string, op string, begin long")
    events.write.parquet(str(tmp_path / "in"))
    done = []
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    watch.apply_to(stream, lambda d: done.append(("delete", sorted(r.path for r in d.collect()))), lambda d: done.append(("change", sorted(r.path for r in d.collect()))), str(tmp_path / "state")).awaitTermination()
    assert done == [("delete", ["a", "b"]), ("change", ["c"])]


def test_env_pairs(spark):
    rows = spark.createDataFrame([("A=1",), ("# B=2",), ("",), (" C = x=y ",)], "value string")
    assert {(r.key, r.val) for r in env_pairs(rows).collect()} == {("A", "1"), ("C", "x=y")}


@pytest.fixture
def tree(tmp_path):
    for path, body in (PROJECT | {"build/gone.py": "x = 1\n", "docs/a.md": "# Title\n\nSome words about vectors.\n", "web/c.js": "export function go(a) {\n  return a;\n}\n", "broken.py": "def f(:\n"}).items():
        (tmp_path / "tree" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / path).write_text(body)
    return tmp_path


def test_engine_end_to_end(spark, tree):
    config = EngineConfig(str(tree / "tree"), dimensions=64)
    engine = Engine.load_or_build(spark, config, str(tree / "store"))
    assert engine.postings.count() and Engine.build(spark, config).totals.first() == engine.totals.first()
    version = Store(spark, str(tree / "store")).meta()["version"]
    assert Engine.load_or_build(spark, config, str(tree / "store")).files.count() == 7 and Store(spark, str(tree / "store")).meta()["version"] == version
    assert {r.path for r in engine.files.collect()} == {*PROJECT, "docs/a.md", "web/c.js", "broken.py"}
    status = engine.status().first()
    assert (status.files, status.classes, status.parse_errors) == (7, 2, 1)
    assert [r.path for r in engine.file_find("*.py").collect()] == ["broken.py", "far.py", "helper.py", "main.py", "other.py"]
    assert {r.name for r in engine.find_code("^t", search_in="names").collect()} == {"target", "twin"} and {r.name for r in engine.find_code("^go$", search_in="names").collect()} == {"T.go", "go"}
    assert [r.line for r in engine.raw("RETURN", "web").collect()] == ["  return a;"]
    with pytest.raises(ValueError, match="outside"):
        engine.raw("x", "../up")
    with pytest.raises(ValueError, match="mode"):
        engine.search("x", "other")
    assert any(r.symbol == "target" for r in engine.search("target", "semantic", 5).collect()) and engine.search("twin", "keyword").count()
    assert engine.source("other.py", "T.act").first().source == "    def act(self): pass"
    assert {(r.direction, r.name) for r in engine.trace("main.py", "run", depth=1).collect()} >= {("callees", "target"), ("callees", "lone")}
    assert "\ndepends_on:\n" in engine.contracts().where("path = 'main.py' and qualified_name = 'run'").first().text
    assert engine.overview().where("module = 'docs'").first().files == 1 and "broken.py [PARSE ERROR]: syntax error" in engine.outline("broken.py").first().text and engine.outline("no.py").first().text == "File no.py not found in the index."
    assert engine.type_shape("U").first().fields == ["t: T"]


def test_engine_update_equals_build(spark, tree):
    config = EngineConfig(str(tree / "tree"), dimensions=16)
    engine = Engine.load_or_build(spark, config, str(tree / "store"))
    (tree / "tree" / "helper.py").write_text("def target(): pass\n")
    (tree / "tree" / "far.py").unlink()
    rebuilt = Engine.build(spark, config)
    gone = spark.createDataFrame([("far.py",)], "path string")
    updated = engine.updated(rebuilt.files, gone)
    for name in ("symbols", "regions"):
        key = lambda df: sorted(map(str, df.select("path", "start_line", "end_line").collect()))
        assert key(getattr(updated, name)) == key(getattr(rebuilt, name))
    assert sorted((r.id, r.text) for r in updated.records.collect()) == sorted((r.id, r.text) for r in rebuilt.records.collect())


SOURCES = {
    "go": ("type T struct {\n  x int\n}\n\nfunc (t *T) Get() int {\n  return t.x\n}\n", [("class", "T", 1, 3), ("function", "Get", 5, 7)]),
    "java": ("public class A {\n  public static List<String> get(int a) {\n    if (a > 1) {\n      return call(a);\n    }\n    other(a);\n  }\n}\n", [("class", "A", 1, 8), ("method", "A.get", 2, 7)]),
    "cpp": ("class A : public B {\n  int get() const {\n    return foo(1);\n  }\n};\nstatic int add(int a,\n               int b)\n{\n  return a + b;\n}\nint decl(int);\n", [("class", "A", 1, 5), ("method", "A.get", 2, 4), ("function", "add", 6, 10)]),
    "ruby": ("module M\n  def go?(x)\n    x\n  end\nend\n", [("class", "M", 1, 5), ("method", "M.go?", 2, 4)]),
    "javascript": ("// function no() {}\nexport const f = async (a) => {\n  return a;\n};\nclass C {\n  run(x) {\n    if (x) {\n      y();\n    }\n  }\n}\n", [("function", "f", 2, 4), ("class", "C", 5, 11), ("method", "C.run", 6, 10)]),
    "rust": ("pub struct A {\n  x: u8,\n}\nimpl A {\n    pub fn new() -> Self {\n        A { x: 1 }\n    }\n}\n", [("class", "A", 1, 3), ("method", "A.new", 5, 7)]),
    "kotlin": ("data class P(val x: Int)\nfun String.up(): String {\n  return this\n}\n", [("class", "P", 1, 1), ("function", "up", 2, 4)]),
    "csharp": ("public class A {\n  public async Task<int> Go(int x)\n  {\n    return 1;\n  }\n}\n", [("class", "A", 1, 6), ("method", "A.Go", 2, 5)]),
    "shell": ("go() {\n  ls\n}\nfunction two {\n  ls\n}\n", [("function", "go", 1, 3), ("function", "two", 4, 6)]),
    "lua": ("local function a(x)\n  return x\nend\nfunction M.b()\nend\n", [("function", "a", 1, 3), ("function", "b", 4, 5)]),
    "php": ("<?php\nclass A {\n  public function get($x) {\n    return 1;\n  }\n}\n", [("class", "A", 2, 6), ("method", "A.get", 3, 5)]),
    "scala": ("object A {\n  def go(x: Int) = x\n}\n", [("class", "A", 1, 3), ("method", "A.go", 2, 2)]),
    "swift": ("struct A {\n  func go() {\n  }\n}\n", [("class", "A", 1, 4), ("method", "A.go", 2, 3)]),
    "c": ("struct p {\n  int x;\n};\nint main(void) {\n  return f(1);\n}\n", [("class", "p", 1, 3), ("function", "main", 4, 6)]),
}


@pytest.mark.parametrize("language", SOURCES)
def test_definitions_by_language(language):
    body, want = SOURCES[language]
    assert [(r["kind"], r["qualified_name"], r["start_line"], r["end_line"]) for r in scanner.scan_source(language, "p", body)] == want
    assert scanner.scan_source(language, "p", "") == []


def test_registered_extractor_and_table_functions(spark):
    def fail(path, text):
        raise KeyError(path)

    known = symbols.extractors() | {".zz": lambda path, text: [{"path": path, "kind": "function", "name": text, "start_line": 1}], ".bad": fail}
    files = spark.createDataFrame([("a.zz", "hello"), ("b.bad", ""), ("c.go", "func main() {\n}\n"), ("d.unknown", "x"), ("e.py", None)], "path string, text string")
    got = {(r.path, r.kind, r.name) for r in symbols.symbols_of_files(files, known).where("kind <> 'module'").collect()}
    assert got == {("a.zz", "function", "hello"), ("b.bad", "error", None), ("c.go", "function", "main")}
    udtfs.register(spark)
    files.createOrReplaceTempView("some_files")
    assert [(r.path, r.name) for r in spark.sql("SELECT path, s.name FROM some_files, LATERAL symbols_of(path, text) s WHERE s.kind = 'function'").collect()] == [("c.go", "main")]
    assert [r.line for r in spark.sql("SELECT l.line FROM some_files, LATERAL lines_of(text) l WHERE path = 'c.go' ORDER BY l.line_no").collect()] == ["func main() {", "}"]
    assert spark.sql("SELECT r.* FROM some_files, LATERAL regions_of(path, text) r WHERE path = 'c.go'").first().region == "func main() {\n}"


def test_trace_bodies_by_a_plain_fold(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["callees", "callers"]), f"p{k % 5}", f"n{k}", rng.randint(1, 3), rng.choice([None, "c", "c\nd"]), rng.choice([None, "", "\n".join("x" * rng.randint(1, 6))])) for k in range(40)]
    df = spark.createDataFrame(rows, "direction string, path string, name string, depth int, contract string, source string").repartition(3)
    for include in ("contracts", "full", "mixed"):
        for budget in (1, 7, 30, 1000):
            used, want = 0, []
            for way, path, name, depth, contract, source in sorted(rows, key=lambda r: (r[0], r[3], r[1], r[2])):
                if used >= budget:
                    break
                lines = (source or "").count("\n") + 1
                fits = bool(source) and (include == "full" or include == "mixed" and depth == 1) and used + lines <= budget
                body = source if fits else contract if contract is not None else name
                used += body.count("\n") + 1
                want.append((way, path, name, depth, "full" if fits else "contract", body))
            assert [tuple(r) for r in graph.bodies(df, budget, include).collect()] == want
    with pytest.raises(ValueError, match="include"):
        graph.bodies(df, 5, "other")
    assert graph.bodies(df.limit(0), 5, "full").count() == 0


def test_roots_and_environment(tmp_path):
    home, inner = tmp_path / "home", tmp_path / "home" / "work" / "src"
    inner.mkdir(parents=True)
    (home / ".git").mkdir()
    assert resolve_root({}, str(inner), str(home)) == str(inner)
    (home / "work" / "go.mod").touch()
    assert resolve_root({}, str(inner), str(home)) == str(home / "work")
    assert resolve_root({"PWD": str(inner)}, str(home), str(home)) == str(home / "work")
    assert resolve_root({"REPO_ROOT": str(home)}, str(inner), str(home)) == str(home)
    config = EngineConfig.from_env({"REPO_ROOT": str(home), "LANGUAGES": "go, rust", "INCLUDE_PRIVATE_FUNCTIONS": "TRUE"})
    assert (config.root, config.languages, config.include_private, config.exclude) == (str(home), ("go", "rust"), True, ())


def test_hit_lines_and_first_hits(spark):
    lines = spark.createDataFrame([("a/b.py:3-9 symbol async C.go(x: int)->bool",), ("a.py file",), ("[none]",), ("...and 3 more",), ("",), ("x.py:1 class Big",)], "line string")
    assert [r[0] for r in lines.select(retrieval.hit_id(F.col("line"))).collect()] == ["a/b.py::C.go", "a.py::", None, None, None, "x.py::Big"]
    wanted = spark.createDataFrame([(1, ["b.PY", "zzz"]), (2, ["none"]), (3, [])], "query_id int, accepted array<string>")
    hits = spark.createDataFrame([(1, 1, "q"), (1, 2, "a/b.py"), (1, 3, "b.py"), (2, 1, "x")], "query_id int, rank int, id string")
    assert {r.query_id: r.rank for r in retrieval.first_hits(wanted, hits).collect()} == {1: 2, 2: None, 3: None}
    made = symbols.python_symbols(spark.createDataFrame([("m.py", 'def f():\n    """Adds up all the numbers given."""\ndef g():\n    """Short."""\n')], "path string, text string"))
    assert [tuple(r) for r in retrieval.docstring_queries(made).collect()] == [("Adds up all the numbers given.", "m.py::f")]


def test_names_and_blocks(spark):
    rows = spark.createDataFrame([("a/x",), ("a/b/c/x",), ("keep/x",), ("a/y",), ("keeper/x",)], "path string")
    assert [r.path for r in rows.where(paths.named_within(F.col("path"), ["x"], 3, ["keep"])).collect()] == ["a/x", "keeper/x"]
    both = spark.createDataFrame([("one\ntwo\n", "\n two \n"), ("one", "two")], "text string, block string")
    assert [r[0] for r in both.select(text.holds_block(F.col("text"), F.col("block"))).collect()] == [True, False]


def test_polling_acts_once_things_are_quiet():
    marks, acted, stop = iter(["a", "a", "b", "c", "c", "c"]), [], threading.Event()

    def act():
        acted.append(1)
        if len(acted) == 1:
            raise OSError("first try fails")
        stop.set()

    watch.poll(lambda: next(marks, "c"), act, stop, 0.001, 0.001, 0.001)
    assert len(acted) == 2


def test_engine_traces_with_bodies_and_overview_modes(spark, tree):
    engine = Engine.build(spark, EngineConfig(str(tree / "tree"), dimensions=16))
    near = {(r.direction, r.name): (r.shown, r.text) for r in engine.trace("main.py", "run", "callees", 1, include="mixed").collect()}
    assert near["callees", "target"][0] == "full" and near["callees", "target"][1].startswith("def target")
    assert {r.shown for r in engine.trace("main.py", "run", "callees", 1, include="contracts").collect()} == {"contract"}
    assert engine.trace("main.py", "run", "callees", 1, include="contracts", budget_lines=1).count() == 1
    with pytest.raises(ValueError, match="direction"):
        engine.trace("main.py", "run", "up")
    assert "twin" in {r.callee for r in engine.ambiguities("far.py").collect()}
    assert {r.path for r in engine.overview(mode="auto").collect()} == {r.path for r in engine.files.collect()}
    with pytest.raises(ValueError, match="mode"):
        engine.overview(mode="other")
    go = engine.symbols.where("path = 'web/c.js' and name = 'go'").first()
    assert (go.start_line, go.end_line) == (1, 3)


def test_flush_waits_for_what_has_come(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"x": 1}\n')
    stream = spark.readStream.schema("x int").json(str(tmp_path / "in")).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "marks")).start()
    try:
        assert watch.flush(stream, 60)
        assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    finally:
        stream.stop()


def test_scan_prunes_and_reads_ignore_files(spark, tmp_path):
    root = tmp_path / "a [b] + c%20d"
    for name in ("keep.py", "gone.py", "out/x.py", ".git/y.py", "sub/deep é.py", "sub/secret/z.py", "notes.bin"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("x = 1\n")
    (root / ".gitignore").write_text("gone.py\nsecret/\n")
    config = EngineConfig(str(root))
    assert [r[0] for r in walk(spark, config)] == ["keep.py", "sub/deep é.py"]
    assert {r.path for r in scan(spark, config).collect()} == {"keep.py", "sub/deep é.py"}
    assert [r.path for r in scan(spark, config, ["keep.py", "gone.py"]).collect()] == ["keep.py"]
    assert scan(spark, EngineConfig(str(root / "out"), exclude=("x.py",))).count() == 0


def test_path_test_is_the_filter_of_columns(spark):
    rng, names = random.Random(5), ["a", "b.py", "build", "c.txt", ".git", "d.zzz", "py"]
    every = sorted({"/".join(rng.choice(names) for _ in range(rng.randint(1, 4))) for _ in range(300)})
    rules = ("/a/**/b.py", "c.txt", "!/b.py/c.txt", "py/")
    df = spark.createDataFrame([(p,) for p in every], "path string")
    want = {r.path for r in df.where(paths.wanted(F.col("path"), ignore_lines=rules)).collect()}
    keeps = paths.path_test(ignore_lines=rules)
    assert {p for p in every if keeps(p, False) and all(keeps("/".join(p.split("/")[:k]), True) for k in range(1, p.count("/") + 1))} == want


def test_store_pointers_are_only_added(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.meta() == {} and store.load() is None
    first = store.save({"t": spark.range(2)}, mark="1")
    second = store.save({"t": spark.range(3)}, mark="2")
    assert first != second == store.meta()["version"] and store.load(mark="1") is None and store.load(mark="2")["t"].count() == 3
    assert len(list((tmp_path / "s" / "_meta").glob("[0-9]*"))) == 2


def test_engine_refreshes_and_takes_a_model(spark, tree):
    calls = spark.sparkContext.accumulator(0)

    def encode(body):
        calls.add(1)
        return np.array([float("vectors" in body), 1.0, 0.0])

    def fail(hits):
        return hits.withColumn("score", F.raise_error(F.lit("no model")))

    config = EngineConfig(str(tree / "tree"), dimensions=2, encode=encode, rerank=fail)
    engine = Engine.load_or_build(spark, config, str(tree / "store"))
    assert calls.value and engine.postings.where("term = 'vectors'").count() and engine.search("about vectors", "semantic", 3).first().path == "docs/a.md"
    assert engine.refreshed(str(tree / "store")) is engine
    (tree / "tree" / "helper.py").write_text("def fresh(): pass\n")
    (tree / "tree" / "far.py").unlink()
    assert engine.source("helper.py", "target").count() and "fresh" in engine.source("helper.py", "target", fresh=True).first().source
    now = engine.refreshed(str(tree / "store"))
    rebuilt = Engine.load_or_build(spark, config, str(tree / "store"))
    assert {r.path for r in now.files.collect()} == {r.path for r in rebuilt.files.collect()} and "far.py" not in {r.path for r in now.files.collect()}
    assert now.symbols.where("name = 'fresh'").count() == 1 == rebuilt.symbols.where("name = 'fresh'").count()
    events = spark.createDataFrame([("helper.py", "delete", 1)], "path string, op string, begin long")
    events.write.parquet(str(tree / "events"))
    (tree / "tree" / "helper.py").unlink()
    query, current = watch.keep_fresh(spark.readStream.schema(events.schema).parquet(str(tree / "events")), now, str(tree / "store"), str(tree / "marks"))
    query.awaitTermination()
    assert "helper.py" not in {r.path for r in current().files.collect()} and current().counts().count()


def test_keyword_says_how_many_more(spark, tree):
    (tree / "tree" / "many.py").write_text("".join(f"def f{k}(): pass\n" for k in range(60)))
    engine = Engine.build(spark, EngineConfig(str(tree / "tree"), dimensions=8))
    lines = [r.line for r in engine.keyword("^f[0-9]", search_in="names").collect()]
    assert len(lines) == 51 and lines[0] == "many.py:1 f0()->None" and lines[-1].startswith("...and 10 more.")
    assert engine.search("^f[0-9]", "keyword", 5).count() == 5
    assert {r.part for r in engine.source_and_trace("main.py", "run").collect()} >= {"source", "callees"}


def test_raw_search_reads_lines(spark):
    files = spark.createDataFrame([("a", "x = 1\nimport os\n"), ("b", "foo\nbar"), ("c", "none")], "path string, text string")
    assert [(r.path, r.line_no) for r in retrieval.raw_search(files, "^import").collect()] == [("a", 2)]
    assert [(r.path, r.line_no) for r in retrieval.raw_search(files, r"1$|\Abar|foo(?!\s*bar)", first_only=False).orderBy("path", "line_no").collect()] == [("a", 1), ("b", 1), ("b", 2)]
