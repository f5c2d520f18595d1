"""Work is dealt over tasks, and what grows with the files is never sent to all of them."""

import ast
import io
from contextlib import redirect_stdout
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodex.operators import symbols, views
from lodex.plans import code, syntax

SF, SMALL = "/root/testdata/sf0.1", "/root/testdata/sf0.001"


@pytest.mark.parametrize("made", [code.modules, syntax._nested, code.js_symbols, syntax.syntax_symbols, syntax.recovered_modules, code.parse_errors])
def test_files_are_written_in_several_tasks(spark, made):
    """The table is one small file, so that it alone would be one task."""
    assert made(spark, SF).rdd.getNumPartitions() >= 4


@pytest.mark.parametrize("made", [code.best_match_join, code.confident_calls, code.ambiguity_report, code.call_counts, code.external_calls, code.outlines, code.compact_outlines, code.type_shapes, code.import_maps, code.suffix_join, code.locator_to_entry, syntax.shallowest_entries])
def test_nothing_that_grows_is_broadcast(spark, made):
    out = io.StringIO()
    with redirect_stdout(out):
        made(spark, SMALL).explain()
    assert "Broadcast" not in out.getvalue()


def test_nodes_and_texts_are_those_of_ast():
    for path in sorted(Path(symbols.__file__).parents[1].rglob("*.py")):
        tree = ast.parse(path.read_text())
        assert symbols._walk(tree) == list(ast.walk(tree))
        for x in ast.walk(tree):
            if isinstance(x, ast.expr) and not isinstance(x, ast.JoinedStr | ast.FormattedValue):
                assert symbols._text(x) == ast.unparse(x)
    for text in ("1j", "1e999", "u'x'", "b'x'", "...", "(1).real", "'a'.b", "f().g", "a.b[c].d", "-1", "None", "'\\n\\'\"'"):
        assert symbols._text(ast.parse(text, mode="eval").body) == ast.unparse(ast.parse(text, mode="eval").body)


def test_a_task_hands_rows_on(monkeypatch, spark):
    """Rows of many files are several batches, and none is lost."""
    monkeypatch.setattr(symbols, "ROWS", 10)
    files = spark.range(50).select(F.concat(F.lit("m"), "id", F.lit(".py")).alias("path"), F.concat(F.lit("def f"), "id", F.lit("(): pass\nX = 1\n")).alias("text"))
    assert sorted((r.kind, r.n) for r in symbols.python_symbols(files).groupBy("kind").agg(F.count_distinct("path").alias("n")).collect()) == [("constant", 50), ("function", 50), ("module", 50)]


@pytest.mark.parametrize("made", [code.outlines, code.compact_outlines])
def test_a_files_rows_meet_once(spark, made):
    """One join for the modules' names, one of modules and their lines."""
    out = io.StringIO()
    with redirect_stdout(out):
        made(spark, SMALL).explain()
    assert out.getvalue().count("Join") <= 2 and "Union" not in out.getvalue()


def test_a_files_lines_are_in_order(spark):
    text = "import sys as s, os\nfrom a import b as c, d\nfrom z import *\nfrom a import d, e\nB = 2\ndef f(): pass\nclass K:\n    def m(self): pass\n    def _p(self): pass\n@dataclass\nclass T:\n    x: int\n    def t(self): pass\nclass K:\n    def n(self): pass\n"
    files = spark.createDataFrame([("k.py", text, 15), ("none.py", "", 0)], "path string, text string, line_count int")
    rows = symbols.python_symbols(files)
    assert {r.path: r.text for r in views.outline(files, rows, True).collect()} == {"k.py": "k.py [4fn, 15L]\n  f  L6-6\n  T.t  L13-13\n  K.m  L8-8\n  K.n  L15-15", "none.py": "none.py [0fn, 0L]"}
    want = ["# imports: s, os | a: d,b as c,e | z: *", "# consts: B=2", "  f()->None  L6-6", "  T{x:int}", "  class K", "    m()->None  L8-8", "    n()->None  L15-15"]
    assert views.outline(files, rows).where("path = 'k.py'").first().text.split("\n")[1:] == want
