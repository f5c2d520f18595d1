"""A query parses whole files once, and only what it reads leaves Python or is written."""

import ast
import dataclasses
import gc
from pathlib import Path

import pytest

from lodex.operators import recovery, scanner, symbols
from lodex.plans import code, syntax

SMALL = "/root/testdata/sf0.001"
ONCE = [code.type_entries, code.py_params, code.py_raises_and_decorators, code.signatures, code.tier1_lines, code.hit_lines, code.file_one_liners, code.name_locators, code.index_status]


@pytest.mark.parametrize("made", ONCE)
def test_symbols_that_are_read_once_are_not_written(spark, monkeypatch, made):
    monkeypatch.setattr(code, "stage", lambda *_: pytest.fail("written"))
    assert made(spark, SMALL).columns


@pytest.mark.parametrize("made", [code.call_counts, code.external_calls, code.suffix_join, code.import_maps, code.locator_to_entry, code.outlines, code.compact_outlines, syntax.shallowest_entries])
def test_symbols_that_are_read_often_are_written_once_and_in_part(spark, monkeypatch, made):
    held = []
    for plans in (code, syntax):
        monkeypatch.setattr(plans, "stage", lambda df, name: held.append(df.columns) or df, raising=False)
    made(spark, SMALL)
    assert len(held) == 1 and len(held[0]) < len(symbols.COLUMNS)


@pytest.mark.parametrize("columns, kinds", [code.CALLS, code.LOCATORS, code.IMPORTS, code.OUTLINES, (code.FIELDS, "class"), ("path kind is_generator raises", "method"), ("kind", "")])
def test_a_part_of_the_symbols_is_that_of_all(spark, columns, kinds):
    files = spark.createDataFrame([(str(f), f.read_text()) for f in sorted(Path(symbols.__file__).parents[1].rglob("*.py"))] + [("bad.py", "x = 1 1\ndef f(): pass")], "path string, text string")
    whole = symbols.python_symbols(files)
    want = whole.where(whole.kind.isin(kinds.split())) if kinds else whole
    got = symbols.python_symbols(files, columns.split(), kinds.split())
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(*columns.split()).collect()))


def test_nodes_that_are_told_are_those_of_ast():
    for path in sorted(Path(symbols.__file__).parents[1].rglob("*.py")):
        for x in ast.walk(ast.parse(path.read_text())):
            if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef):
                every = list(ast.walk(x))
                assert symbols._told_nodes(x) == [y for y in every if type(y) in symbols._TOLD]
                assert [y for y in symbols._statements(x) if isinstance(y, ast.stmt)] == [y for y in every if isinstance(y, ast.stmt)]


def test_cycles_are_collected_after_a_file():
    seen = []
    symbols.rows_of({".py": lambda p, t: seen.append(gc.isenabled()) or []}, "a.py", "")
    assert seen == [False] and gc.isenabled()


@pytest.mark.parametrize("columns, kinds, unmade", [("path kind doc_first", "module", ("_function", "_class", "_nested")), ("path name params", "function method", ("_class", "_nested", "_doc", "_told_nodes")), (code.IMPORTS[0], code.IMPORTS[1], ("_function", "_class", "_doc"))])
def test_rows_that_nothing_reads_are_not_made(monkeypatch, columns, kinds, unmade):
    whole = symbols.parse_python("a.py", Path(symbols.__file__).read_text())
    for name in unmade:
        monkeypatch.setattr(symbols, name, lambda *_: pytest.fail("made"))
    got = symbols.parse_python("a.py", Path(symbols.__file__).read_text(), frozenset(columns.split()), frozenset(kinds.split()))
    told = lambda rows: [[r.get(c) for c in columns.split()] for r in rows if r["kind"] in kinds.split()]
    assert told(got) == told(whole)


def test_lists_of_structs_are_those_of_arrow():
    rows = [r for f in sorted(Path(symbols.__file__).parents[1].rglob("*.py")) for r in symbols.parse_python(str(f), f.read_text())] + [{}]
    for column in ("params", "class_attrs", "instance_attrs", "calls"):
        kind, values = symbols._ARROW.field(column).type, [r.get(column) for r in rows]
        assert symbols._column(values, kind).equals(symbols.pa.array(values, kind)) and any(values)
    for values in ([], [None], [[]], [[{"callee": "f"}], None, [], [None], [{"n": 1}]]):
        made = symbols._column(values, symbols._ARROW.field("calls").type)
        made.validate(full=True)
        assert made.to_pylist() == symbols.pa.array(values, made.type).to_pylist()


class _Counted:
    """A lexer that tells how often it is asked."""

    def __init__(self, lexer):
        self.lexer, self.asked = lexer, 0

    def finditer(self, *a):
        self.asked += 1
        return self.lexer.finditer(*a)

    def search(self, *a):
        self.asked += 1
        return self.lexer.search(*a)


@pytest.mark.parametrize("language, text, most", [("go", "func f(a int) { g(a) }\n", 1), ("javascript", "x = /}/g; function f() { return /a/ }\n", 3)])
def test_a_text_is_cut_into_tokens_in_one_go(monkeypatch, language, text, most):
    """Once, and once more behind each pattern between slashes."""
    lexer = _Counted(scanner.RULES[language].lexer)
    rules = dataclasses.replace(scanner.RULES[language], lexer=lexer)
    monkeypatch.setattr(scanner, "_JS", rules if language == "javascript" else scanner._JS)
    tokens = scanner.Tokens(rules, text)
    assert lexer.asked <= most and "f" in tokens.text and tokens.text[tokens.close[tokens.text.index("{")]] == "}"


def test_lines_of_sound_parts_are_shifted_in_one_walk(monkeypatch):
    monkeypatch.setattr(ast, "walk", lambda *_: pytest.fail("walked"))
    tree, errors = recovery.recovered("x = 1 1\n\ndef f(a=1):\n    return [\n        g(x) for x in a]\n")
    f = tree.body[0]
    assert errors and (f.lineno, f.end_lineno, f.body[0].value.elt.lineno, f.args.defaults[0].end_lineno) == (3, 5, 5, 3)


@pytest.mark.parametrize("made, kinds", [(code.index_status, {"function", "method", "class", "error"}), (syntax.recovered_modules, {"function", "method", "class", "error"}), (code.compact_outlines, {"module", "function", "method", "class", "error"})])
def test_only_the_kinds_that_are_counted_are_made(spark, monkeypatch, made, kinds):
    asked, whole = [], symbols.python_symbols
    monkeypatch.setattr(symbols, "python_symbols", lambda files, columns=(), kinds=(): asked.append(set(kinds)) or whole(files, columns, kinds))
    assert made(spark, SMALL).columns and asked == [kinds]
