"""What a file's symbols tell of each other is found in the file's own row; only what is left moves."""

import io
from contextlib import redirect_stdout
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodex.operators import graph, symbols, views
from lodex.plans import code, syntax
from lodex.sources import staging

SMALL = "/root/testdata/sf0.001"
ODD = """from a import f as g, h as g
from b import one as two, f
import numpy as np
def f(): g(); two(); np.two(); f().g(); a[0].h(); other()(); x.y.g()
def empty(): pass
class K:
    def one(self): self.one(); self.none(); len(self); g(); g()
    def f(self): super().f()
def f(): g(); h()
"""


@pytest.fixture(scope="module")
def files(spark):
    own = [(str(f), f.read_text()) for f in sorted(Path(symbols.__file__).parents[1].rglob("*.py"))]
    return spark.createDataFrame([*own, ("odd.py", ODD), ("empty.py", ""), ("null.py", None), ("bad.py", "x = 1 1\ndef f(): g()"), ("not.txt", "f()")], "path string, text string").repartition(3)


def _plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def _sorted(df) -> list[str]:
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("rows", [1, 7, 4096])
@pytest.mark.parametrize("columns, kinds", [(("kind", "name", "params", "calls"), ()), code.CALLED])
def test_symbols_by_file_are_those_of_files(spark, monkeypatch, files, rows, columns, kinds):
    monkeypatch.setattr(symbols, "ROWS", rows)
    columns, kinds = (x.split() if isinstance(x, str) else x for x in (columns, kinds))
    whole = symbols.python_symbols(files)
    want = whole.where(whole.kind.isin(list(kinds))) if kinds else whole
    want = {r.path: r.s for r in want.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ord", *columns))).alias("s")).collect()}
    got = symbols.python_symbols(files, columns, kinds, by_file=True).collect()
    assert sorted(r.path for r in got) == sorted(r.path for r in files.where("path <> 'not.txt'").collect())
    assert {r.path: [tuple(s) for s in r.symbols] for r in got if r.symbols} == {p: [tuple(s)[1:] for s in held] for p, held in want.items()}


def test_external_calls_are_those_that_resolving_leaves(files):
    want = graph.resolve_calls(symbols.python_symbols(files)).where("is_external").groupBy("callee").agg(F.count("*").alias("calls"))
    got = graph.external(graph.called_names(symbols.python_symbols(files, *(x.split() for x in code.CALLED), by_file=True)))
    assert _sorted(got) == _sorted(want) and {"g", "len", "np.two", "super", "self.none"} & {r.callee for r in got.collect()}


def test_external_calls_move_as_counts(spark, monkeypatch):
    """Modules are joined to names once, counts to names once; no call or symbol is written or sorted by itself."""
    held = []
    monkeypatch.setattr(code, "stage", lambda df, _: held.append(df) or df)
    made = _plan(code.external_calls(spark, SMALL))
    assert set(held[0].columns) == {"lookup", "callee", "calls"} and _plan(held[0]).count("Join") == 1 and made.count("Join") <= 3


NAMES = ("f", "one", "K.one", "K", "missing", "self", "_cuts", "rows", "fold", "regions.fold", "made", "parse", None)


def test_entries_by_file_are_those_of_rows(spark, files):
    deep = "class A:\n    def f(self):\n        def g(): pass\n    class B:\n        def g(self): pass\ndef z():\n    def f(): pass\n    def h():\n        def g(): pass\ndef g2(): pass\nclass g3:\n    def g2(self): pass\n"
    files = files.unionByName(spark.createDataFrame([("deep.py", deep)], files.schema))
    rows, names = symbols.python_symbols(files), (*NAMES, "g", "h", "A.B.g", "g2", "f")
    wanted = files.where("path <> 'bad.py'").select("path", F.explode(F.array(*map(F.lit, names))).alias("wanted"))
    by_file = symbols.python_symbols(files, *(x.split() for x in code.ENTRIES), by_file=True)
    got = graph.find_entries(by_file, F.when(F.col("path") != "bad.py", F.array(*map(F.lit, names))))
    assert _sorted(got) == _sorted(graph.find_entry(rows, wanted)) and got.where("path = 'deep.py'").count() >= 5


@pytest.mark.parametrize("made", [code.locator_to_entry, syntax.shallowest_entries])
def test_entries_are_found_where_their_file_is(spark, made):
    """What is written by file is read once, and nothing moves any more."""
    plan = _plan(made(spark, SMALL))
    assert "Exchange" not in plan and "Join" not in plan and plan.count("FileScan") == 1


IMPORTING = "import a.b.c\nimport d as e\nfrom pkg.m import f as g, h, f as other\nfrom . import x as y\nfrom ..up.q import z as g\nfrom k import h\n"


def test_imports_by_file_are_those_of_rows(spark, files):
    files = files.unionByName(spark.createDataFrame([("imports.py", IMPORTING)], files.schema))
    named, aliases = graph.import_maps(symbols.python_symbols(files))
    held, originals = graph.file_imports(F.col("symbols"))
    got = symbols.python_symbols(files, *(x.split() for x in code.SUFFIXES), by_file=True).select("path", held.alias("named"), originals.alias("originals")).collect()
    assert sorted((r.path, k, v) for r in got for k, v in dict(r.named).items()) == sorted(map(tuple, named.select("path", "local", "target").collect()))
    assert sorted((r.path, x) for r in got for x in r.originals) == sorted(map(tuple, aliases.select("path", "original").collect()))


def test_paths_by_suffix_are_those_of_locators(spark):
    wanted = spark.createDataFrame([("f", "a/b.py"), ("f", "b.py"), ("g", "x/a/b.py"), ("g", "y/a/b.py"), ("f", "none.py"), ("h", "b.py"), ("f", "/a/b.py")], "lookup string, target string")
    paths = ("b.py", "a/b.py", "x/a/b.py", "z/a/b.py", "/a/b.py", "ab.py", "a/bb.py")
    found = spark.createDataFrame([("function", p, None, n, n, k, 1, 2) for p in paths for k, n in enumerate(("f", "g"))], "kind string, path string, class_name string, name string, qualified_name string, ord int, start_line int, end_line int")
    want = graph.suffix_matches(wanted, graph.locators(found).withColumnRenamed("name", "lookup")).select("lookup", "target", F.col("in_target.l_path").alias("to_path"))
    got = graph.suffix_paths(wanted, found.groupBy(F.col("path").alias("l_path")).agg(F.collect_set("name").alias("lookups")))
    assert _sorted(got) == _sorted(want) and got.count() == 5


def test_suffixes_meet_in_one_join(spark):
    """Names and targets meet once, what is found and the modules once; imports need none."""
    plan = _plan(code.suffix_join(spark, SMALL))
    assert plan.count("Join") == 2 and "Union" not in plan


@pytest.mark.parametrize("most", [0, 100_000])
def test_calls_from_a_front_are_those_of_all_calls(spark, monkeypatch, files, most):
    """Also where the front is sorted rather than sent to all tasks."""
    monkeypatch.setattr(staging, "FEW", most)
    rows = staging.stage(symbols.python_symbols(files), "rows")
    every = staging.stage(graph.resolve_calls(rows), "calls")
    front = rows.where("qualified_name in ('f', 'K.one', 'K.f', 'regions', 'resolve_calls', 'Engine.trace')").select("path", F.col("qualified_name").alias("name"))
    want = every.join(front.withColumnRenamed("name", "caller"), ["path", "caller"], "left_semi").select(every.columns)
    got = graph.calls_from(rows, front)
    assert _sorted(got) == _sorted(want) and want.count() >= 30 and want.where("not is_external").count() >= 5
    edges = every.where("not is_external").select(F.struct("path", "caller").alias("src"), F.struct(F.col("to_path").alias("path"), F.col("to_name").alias("caller")).alias("dst"))
    want = graph.trace(edges, front.select(F.struct("path", F.col("name").alias("caller")).alias("node")), 2).select("node.path", F.col("node.caller").alias("name"), "depth")
    assert _sorted(graph.trace_calls(rows, front, 2)) == _sorted(want) and want.where("depth = 2").count()


def test_a_trace_resolves_what_it_reaches(spark, monkeypatch):
    """Of some 4,000 symbols few are handed to the joins: those of the files that a step stands in, and what they call."""
    held, resolve = [], graph.resolve_calls
    monkeypatch.setattr(graph, "resolve_calls", lambda rows: held.append(rows.count()) or resolve(rows))
    assert code.trace_modules(spark, SMALL).count() and len(held) == 2 and max(held) < 200


CALLING = "from odd import f as ff\nclass K:\n    w: K\n    z: 'far.T'\n    u: Optional[a.T[int]] | None\n    def one(self): self.w.one(); cls.one(); self.z.act(); w.one(); K.one(); self.u.act(); self.one.x()\n    def two(self): ff(); zz.act()\nclass T:\n    def act(self): self.act()\n"


def test_calls_resolved_by_file_are_those_of_joins(spark, monkeypatch, files):
    """Also where every name, or none, is sent to all tasks; and contracts are the same with and without a table of callers."""
    files = files.unionByName(spark.createDataFrame([(p, t) for p, t in (("imports.py", IMPORTING), ("calling.py", CALLING), ("a/calling.py", CALLING), ("a/odd.py", ODD))], files.schema))
    rows, own = staging.stage(symbols.python_symbols(files), "rows"), staging.stage(symbols.python_calls(files), "own")
    calls = staging.stage(graph.resolve_calls(rows), "calls")
    want = _sorted(calls)
    assert {r.confidence for r in calls.collect()} == {"exact", "preferred", "ambiguous"}
    for hot in (1000, 1, 10**9):
        monkeypatch.setattr(graph, "HOT", hot)
        assert _sorted(graph.resolve_files(own)) == want
    assert _sorted(views.tier2(rows, calls)) == _sorted(views.tier2(rows, calls, graph.callers(calls)))


def test_contracts_parse_modules_once(spark, monkeypatch):
    """Calls of names that all modules share meet no join: what moves is three open calls a module and what they ask for."""
    held, made = [], symbols.symbols_of_files
    monkeypatch.setattr(symbols, "symbols_of_files", lambda *a, **k: held.append(a) or made(*a, **k))
    plan = _plan(code.contracts(spark, SMALL))
    assert len(held) == 1 and plan.count("SortMergeJoin") == 1
