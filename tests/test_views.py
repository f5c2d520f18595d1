import pytest

from lodex.config import EngineConfig
from lodex.engine import Engine
from lodex.operators import graph


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    (root / "sub").mkdir()
    (root / "a.py").write_text("def one():\n    def held(): pass\n    two()\n\ndef two(): three()\ndef three(): one()\n")
    (root / "sub" / "b.js").write_text("class C { m(x) { return two(x); } }\n")
    (root / "broken.py").write_text("def ok(): pass\nx = = 1\n")
    (root / "notes.txt").write_text("words\n")
    made = Engine.build(spark, EngineConfig(str(root), dimensions=8))
    (root / "late.py").write_text("def late(): pass\n")
    return made


def test_file_lines_and_absolute_patterns(engine):
    assert [r.line for r in engine.file_lines("*.zzz").collect()] == ["No files matching pattern: *.zzz. Available top-level directories: sub."]
    assert [r.path for r in engine.file_find(f"{engine.config.root}/**/*.js").collect()] == ["sub/b.js"]
    [row] = engine.file_lines("a.py", include_tier1=True).collect()
    assert row.line.startswith("a.py [3fn, ") and "\n  " in row.line and "two" in row.line


def test_status_tells_modes(engine):
    assert engine.status().first().modes == {"error": 1, "lines": 1, "parsed": 2}


def test_outline_of_a_file_that_is_not_indexed(engine):
    assert "late" in engine.outline("late.py").first().text
    assert engine.outline("nowhere.py").first().text == "File nowhere.py not found in the index."


def test_sources_have_a_head_or_say_what_there_is(engine):
    assert engine.shown_source("a.py", "two").first().text == "a.py:two (lines 5-5):\n     5 | def two(): three()"
    assert "held" in engine.shown_source("a.py", "one.held").first().text and engine.source("a.py", "held").first().qualified_name == "one.held"
    assert engine.shown_source("a.py", "four").first().text == "Function four not found in a.py. Available functions: one, two, three."
    assert engine.shown_source("gone.py", "f").first().text == "Function f not found in gone.py. File may not be indexed."


def test_traces_tell_order_and_way(engine):
    rows = engine.trace("a.py", "one", "callees", 3).orderBy("nth").collect()
    assert [(r.name, r.depth, r.nth, r.via) for r in rows] == [("two", 1, 1, ["one"]), ("three", 2, 2, ["one", "two"])]
    assert {r.name: [x.name for x in r.locators] for r in graph.locator_arrays(engine.symbols).collect()}["two"] == ["two"]


def test_docstrings_find_their_own_functions(spark, tmp_path):
    words = ["parse", "header", "socket", "matrix", "render", "token", "widget", "ledger", "planet", "river"]
    body = "".join(f"def f{k}():\n    \"\"\"Handles the {w} of {words[k - 3]} and {words[k - 7]}.\"\"\"\n" for k, w in enumerate(words))
    (tmp_path / "m.py").write_text(body + "def bare(): pass\n")
    row = Engine.build(spark, EngineConfig(str(tmp_path), dimensions=64)).docstring_recall().first()
    assert row.n == 10 and row.recall_at_1 >= 0.9 and row.recall_at_5 == 1.0 and row.mrr >= 0.9
