"""From files to symbols, regions and records."""

from __future__ import annotations

import ast
import gc
import re
from collections.abc import Callable, Iterable, Iterator
from functools import partial
from itertools import accumulate, islice
from math import inf

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodex.config import LANGUAGES, LARGE_BYTES, LARGE_LINES, REGION_CHARS, REGION_LINES, REGIONS, TEXT_LANGUAGES
from lodex.functions.paths import extension
from lodex.functions.text import numbered_lines
from lodex.operators import scanner
from lodex.operators.recovery import recovered, sound, told

# How a line begins that defines a function or a class, and one that begins a region.
FUNCTION_LINES = (
    r"^(?:pub\s+)?fn\s+([A-Za-z_][A-Za-z0-9_]*)",
    r"^(?:export\s+)?(?:async\s+)?function\s+([A-Za-z_][A-Za-z0-9_]*)",
    r"^(?:export\s+)?(?:const|let|var)\s+([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(?:async\s*)?\(",
    r"^(?:export\s+)?(?:const|let|var)\s+([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(?:async\s*)?[_A-Za-z][A-Za-z0-9_<>,\s:*&-]*=>",
    r"^(?:pub\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+\"[^\"]+\"\s+)?fn\s+([A-Za-z_][A-Za-z0-9_]*)",
)
CLASS_LINES = (
    r"^(?:export\s+)?class\s+([A-Za-z_][A-Za-z0-9_]*)",
    r"^(?:pub\s+)?struct\s+([A-Za-z_][A-Za-z0-9_]*)",
    r"^(?:pub\s+)?enum\s+([A-Za-z_][A-Za-z0-9_]*)",
    r"^(?:pub\s+)?trait\s+([A-Za-z_][A-Za-z0-9_]*)",
    r"^(?:export\s+)?interface\s+([A-Za-z_][A-Za-z0-9_]*)",
)
BOUNDARY_LINES = (
    r"^(?:pub\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+\w+",
    r"^(?:export\s+)?(?:async\s+)?function\s+\w+",
    r"^(?:export\s+)?class\s+\w+",
    r"^(?:pub\s+)?(?:struct|enum|trait)\s+\w+",
    r"^(?:def|class)\s+\w+",
    r"^(?:interface|type)\s+\w+",
    r"^#{1,6}\s+\S+",
    r"^\[.+\]$",
    r"^\{?$",
)


def line_symbols(files: DataFrame) -> DataFrame:
    """path, kind, name, start_line by line patterns; of a name defined twice in a file the first counts."""
    line = F.trim(F.col("line"))
    code = numbered_lines(files).where((line != "") & ~line.rlike(r"^(?://|#|/\*|\*)"))
    named = lambda patterns: F.coalesce(*[F.nullif(F.regexp_extract(line, p, 1), F.lit("")) for p in patterns])
    kinds = F.array(F.struct(F.lit("class").alias("kind"), named(CLASS_LINES).alias("name")), F.struct(F.lit("function").alias("kind"), named(FUNCTION_LINES).alias("name")))
    return code.select("path", "line_no", F.explode(kinds).alias("s")).where("s.name is not null").groupBy("path", F.col("s.kind").alias("kind"), F.col("s.name").alias("name")).agg(F.min("line_no").alias("start_line"))


def is_boundary(line: Column) -> Column:
    """Whether a region begins at this line."""
    out = F.lit(False)
    for p in BOUNDARY_LINES:
        out |= F.trim(line).rlike(p)
    return out


_boundary = re.compile("|".join(f"(?:{p})" for p in BOUNDARY_LINES))


def _cuts(lines: list[str], most_lines: float, most_chars: float) -> Iterator[tuple[int, int]]:
    """(first, behind last) of each run of lines that is a region: from a line that isn't blank to a boundary, or to a limit of lines or characters."""
    starts_new = [bool(_boundary.match(x.strip())) for x in lines]
    sizes = [len(x) for x in lines]
    begin = 0
    while begin < len(lines):
        if not lines[begin].strip():
            begin += 1
            continue
        end, size = begin + 1, sizes[begin]
        while end < len(lines) and end - begin < most_lines and not starts_new[end] and size + sizes[end] < most_chars:
            size += sizes[end]
            end += 1
        yield begin, end
        begin = end


def _title(line: str) -> str:
    if line.startswith("#"):
        return line.lstrip("#").strip()[:120]
    return line if len(line) <= 120 else line[:117] + "..."


def _is_prose(line: str) -> bool:
    return " " in line and not any(c in "{}();=<>[]" for c in line)


def fold_regions(path: str, text: str, prose: bool, most: int | None = REGIONS, most_lines: int | None = REGION_LINES, most_chars: int | None = REGION_CHARS) -> list[tuple[int, str, str, str, int, int]]:
    """(number, kind, title, text, first line, last line) of a file's regions: the first ones, of so many lines and characters at most; None is no limit. prose: the file is text."""
    lines = [x.rstrip() for x in text.splitlines()]
    out = []
    for number, (begin, end) in enumerate(islice(_cuts(lines, most_lines or inf, most_chars or inf), most)):
        run = [x.strip() for x in lines[begin:end]]
        kind = "doc" if prose or sum(map(_is_prose, run)) >= max(2, len(run) // 2) else "code"
        out.append((number, kind, _title(run[0]) or path, "\n".join(lines[begin:end]).strip()[:most_chars], begin + 1, end))
    return out


REGION_COLUMNS = "path string, idx int, kind string, title string, text string, start_line int, end_line int"
#: Rows and characters that a task makes before it hands them on.
ROWS, CHARS = 4096, 1 << 22


def regions(files: DataFrame, most: int | None = REGIONS, most_lines: int | None = REGION_LINES, most_chars: int | None = REGION_CHARS, file_bytes: int | None = LARGE_BYTES, file_lines: int | None = LARGE_LINES) -> DataFrame:
    """path, idx, kind, title, text, start_line, end_line of files of so many characters and lines at most; limits as in fold_regions, None is no limit."""

    schema = pa.schema([(n, _arrow_type(t)) for n, t in (c.split(" ") for c in REGION_COLUMNS.split(", "))])
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, chars = [], 0
        for batch in batches:
            for p, t, lang in zip(*batch.columns, strict=True):
                found = fold_regions(p.as_py(), t.as_py() or "", lang.as_py() in TEXT_LANGUAGES, most, most_lines, most_chars)
                rows += [(p.as_py(), *r) for r in found]
                chars += sum(len(r[3]) for r in found)
                if len(rows) >= ROWS or chars >= CHARS:
                    yield made(rows)
                    rows, chars = [], 0
        if rows:
            yield made(rows)

    if file_bytes is not None:
        files = files.where(F.length("text") <= file_bytes)
    if file_lines is not None:
        files = files.where(F.size(F.split("text", "\n")) <= file_lines)
    return files.select("path", "text", "language").mapInArrow(fold, REGION_COLUMNS)


PARAM = "struct<name:string,annotation:string,has_default:boolean,default_value:string,variadic:boolean,kw_variadic:boolean>"
ATTR = "struct<name:string,annotation:string,has_default:boolean,default_value:string>"
SYMBOLS = (
    "path string, kind string, class_name string, name string, qualified_name string, ord int, start_line int, end_line int, visibility string, is_async boolean, is_generator boolean, is_static boolean, is_classmethod boolean, is_property boolean, is_abstract boolean, "
    f"params array<{PARAM}>, return_type string, doc_first string, doc_full string, decorators array<string>, raises array<string>, bases array<string>, class_attrs array<{ATTR}>, instance_attrs array<{ATTR}>, "
    "calls array<struct<callee:string,ord:int,n:int>>, module string, names array<string>, alias string, value string, error string, depth int, parent string"
)
def _arrow_type(kind: str) -> pa.DataType:
    if kind.startswith("array<"):
        return pa.list_(_arrow_type(kind[6:-1]))
    if kind.startswith("struct<"):
        return pa.struct([(n, _arrow_type(t)) for n, t in (f.split(":") for f in kind[7:-1].split(","))])
    return {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[kind]


_TYPES = dict(c.split(" ") for c in re.split(r", (?=\w+ )", SYMBOLS))
_ARROW = pa.schema([(n, _arrow_type(t)) for n, t in _TYPES.items()])
#: All columns of SYMBOLS.
COLUMNS = frozenset(_TYPES)


def _column(values: list, kind: pa.DataType) -> pa.Array:
    """What pa.array gives; lists of structs, for which it takes long, are put together from their fields."""
    if not (pa.types.is_list(kind) and pa.types.is_struct(kind.value_type)):
        return pa.array(values, kind)
    flat = [x for v in values if v for x in v]
    if not all(type(x) is dict for x in flat):
        return pa.array(values, kind)
    fields = list(kind.value_type)
    held = pa.StructArray.from_arrays([pa.array([x.get(f.name) for x in flat], f.type) for f in fields], fields=fields)
    ends = pa.array(accumulate((len(v) if v else 0 for v in values), initial=0), pa.int32())
    return pa.ListArray.from_arrays(ends, held, type=kind, mask=pa.array([v is None for v in values], pa.bool_()))


def _batch(rows: list[dict], schema: pa.Schema = _ARROW) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_column([r.get(n) for r in rows], t) for n, t in zip(schema.names, schema.types, strict=True)], schema=schema)


def _visibility(name: str) -> str:
    if name.startswith("__") and name.endswith("__"):
        return "public"
    return "private" if name.startswith("__") else "protected" if name.startswith("_") else "public"


def _text(node: ast.AST | None) -> str | None:
    """What ast.unparse gives; names, attributes and items of names and plain constants, which are most, are written here."""
    kind = type(node)
    if node is None or kind is ast.Name:
        return node and node.id
    if kind is ast.Attribute and type(node.value) in (ast.Name, ast.Attribute):
        return f"{_text(node.value)}.{node.attr}"
    if kind is ast.Constant and type(node.value) in (str, int, bool, type(None)) and not node.kind:
        return repr(node.value)
    if kind is ast.Subscript and type(node.value) in (ast.Name, ast.Attribute) and type(node.slice) in (ast.Name, ast.Attribute, ast.Subscript):
        return f"{_text(node.value)}[{_text(node.slice)}]"
    return ast.unparse(node)


def _walk(node: ast.AST) -> list[ast.AST]:
    """The nodes of ast.walk in its order."""
    out = [node]
    for x in out:
        for v in x.__dict__.values():
            if type(v) is list:
                out += [y for y in v if isinstance(y, ast.AST)]
            elif isinstance(v, ast.AST):
                out.append(v)
    return out


def _doc(node) -> tuple[str | None, str | None]:
    full = ast.get_docstring(node, clean=True)
    return (full.strip().split("\n")[0].strip(), full.strip()) if full else (None, None)


def _params(a: ast.arguments) -> list[dict]:
    plain = [*a.posonlyargs, *a.args]
    defaults = [None] * (len(plain) - len(a.defaults)) + list(a.defaults)
    row = lambda arg, default=None, v=False, kw=False: {"name": arg.arg, "annotation": _text(arg.annotation), "has_default": default is not None, "default_value": _text(default), "variadic": v, "kw_variadic": kw}
    out = [row(x, d) for x, d in zip(plain, defaults, strict=True)]
    if a.vararg:
        out.append(row(a.vararg, v=True))
    out += [row(x, d) for x, d in zip(a.kwonlyargs, a.kw_defaults, strict=True)]
    if a.kwarg:
        out.append(row(a.kwarg, kw=True))
    return out


#: What a function's row tells of the nodes within it, and the columns that need them.
_TOLD = frozenset((ast.Call, ast.Raise, ast.Yield, ast.YieldFrom))
_OF_INNER = frozenset(("is_generator", "raises", "calls"))
#: Nodes that hold none of these, and fields that hold no such nodes.
_ENDS = frozenset((ast.Name, ast.Constant, ast.Pass, ast.Break, ast.Continue, ast.Global, ast.Nonlocal, ast.Import, ast.ImportFrom, str, int, bool, type(None)))
_PLAIN = frozenset(("ctx", "op", "ops", "id", "attr", "arg", "kind", "type_comment", "name", "is_async", "simple", "conversion"))
_FIELDS = {k: tuple(f for f in k._fields if f not in _PLAIN) for k in vars(ast).values() if isinstance(k, type) and issubclass(k, ast.AST)}


def _told_nodes(node: ast.AST) -> list[ast.AST]:
    """Those of _TOLD among the nodes of ast.walk, in its order."""
    out, open_ = [], [node]
    for x in open_:
        kind = type(x)
        if kind in _TOLD:
            out.append(x)
        for f in _FIELDS[kind]:
            v = getattr(x, f, None)
            if type(v) is list:
                if v:
                    open_ += [y for y in v if type(y) not in _ENDS]
            elif type(v) not in _ENDS:
                open_.append(v)
    return out


def _statements(node: ast.AST) -> list[ast.AST]:
    """The statements among the nodes of ast.walk, in its order, with what holds them."""
    out = [node]
    for x in out:
        at = x.__dict__
        if "body" in at or "cases" in at:
            out += [y for f in _BODIES if f in at for y in at[f]]
    return out


def _first_line(node) -> int:
    """Of a definition with its decorators."""
    return min([node.lineno, *(d.lineno for d in node.decorator_list)]) if node.decorator_list else node.lineno


#: Statements that define functions, and those that define anything.
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_DEFINITIONS = (*_FUNCTIONS, ast.ClassDef)


def _function(node, owner: str | None, path: str, want: frozenset[str] = COLUMNS) -> dict:
    row = {
        "path": path, "kind": "method" if owner else "function", "class_name": owner, "name": node.name, "qualified_name": f"{owner}.{node.name}" if owner else node.name,
        "start_line": _first_line(node), "end_line": node.end_lineno, "visibility": _visibility(node.name) if "visibility" in want else None, "is_async": type(node) is ast.AsyncFunctionDef,
        "params": _params(node.args) if "params" in want else None, "return_type": _text(node.returns) if "return_type" in want else None, "depth": int(owner is not None), "parent": owner,
    }
    if not want.isdisjoint(_OF_DOC):
        row["doc_first"], row["doc_full"] = _doc(node)
    if not want.isdisjoint(_OF_DECORATORS):
        decorators = [_text(d).split("(")[0] for d in node.decorator_list]
        row |= {"is_static": "staticmethod" in decorators, "is_classmethod": "classmethod" in decorators, "is_property": "property" in decorators, "is_abstract": any(d.split(".")[-1] == "abstractmethod" for d in decorators), "decorators": decorators}
    if not want.isdisjoint(_OF_INNER):
        inner = _told_nodes(node)
        counts: dict[str, int] = {}
        called = [x for x in inner if type(x) is ast.Call] if "calls" in want else []
        for c in sorted(called, key=lambda c: (c.lineno, c.col_offset)) if len(called) > 1 else called:
            if type(c.func) in (ast.Name, ast.Attribute):
                callee = _text(c.func)
                counts[callee] = counts.get(callee, 0) + 1
        raised = [r.exc.func if isinstance(r.exc, ast.Call) else r.exc for r in inner if type(r) is ast.Raise and r.exc is not None] if "raises" in want else []
        row |= {"is_generator": any(type(x) in (ast.Yield, ast.YieldFrom) for x in inner) if "is_generator" in want else None, "raises": list(dict.fromkeys(_text(r) for r in raised)), "calls": [{"callee": c, "ord": k, "n": n} for k, (c, n) in enumerate(counts.items())]}
    return row


#: Columns that need a definition's docstring, its decorators, and a class's attributes.
_OF_DOC, _OF_DECORATORS, _OF_ATTRIBUTES = frozenset(("doc_first", "doc_full")), frozenset(("decorators", "is_static", "is_classmethod", "is_property", "is_abstract")), frozenset(("class_attrs", "instance_attrs"))


def _attributes(body: list[ast.stmt]) -> list[dict]:
    out = []
    for s in body:
        if isinstance(s, ast.AnnAssign) and isinstance(s.target, ast.Name):
            out.append({"name": s.target.id, "annotation": _text(s.annotation), "has_default": s.value is not None, "default_value": _text(s.value)})
        elif isinstance(s, ast.Assign):
            out += [{"name": t.id, "annotation": None, "has_default": True, "default_value": _text(s.value)} for t in s.targets if isinstance(t, ast.Name)]
    return out


def _class(node: ast.ClassDef, path: str, want: frozenset[str] = COLUMNS) -> dict:
    row = {"path": path, "kind": "class", "depth": 0, "name": node.name, "qualified_name": node.name, "start_line": _first_line(node), "end_line": node.end_lineno, "visibility": _visibility(node.name), "bases": [_text(b) for b in node.bases] if "bases" in want else None}
    if want & _OF_DOC:
        row["doc_first"], row["doc_full"] = _doc(node)
    if want & (_OF_DECORATORS | _OF_ATTRIBUTES):
        row["decorators"] = [_text(d).split("(")[0] for d in node.decorator_list]
    if want & _OF_ATTRIBUTES:
        attrs, own = _attributes(node.body), {}
        for f in node.body:
            if isinstance(f, ast.FunctionDef) and f.name == "__init__":
                for s in _statements(f):
                    target = s.target if isinstance(s, ast.AnnAssign) else s.targets[0] if isinstance(s, ast.Assign) else None
                    if isinstance(target, ast.Attribute) and isinstance(target.value, ast.Name) and target.value.id == "self":
                        own.setdefault(target.attr, {"name": target.attr, "annotation": _text(getattr(s, "annotation", None)), "has_default": s.value is not None, "default_value": _text(s.value)})
        data = any(d.split(".")[-1] == "dataclass" for d in row["decorators"])
        row |= {"class_attrs": [] if data else attrs, "instance_attrs": [*(attrs if data else []), *own.values()]}
    return row


#: Where statements hold statements, in the order in which they stand.
_BODIES = ("body", "handlers", "orelse", "finalbody", "cases")


def _held(node) -> list[ast.AST]:
    """The statements right within one, the last first; expressions define no function or class."""
    at = node.__dict__
    return [x for f in _BODIES if f in at for x in at[f]][::-1] if "body" in at or "cases" in at else []


def _nested(node, full: str, depth: int, path: str, want: frozenset[str] = COLUMNS, only: frozenset[str] = frozenset()) -> list[dict]:
    """Functions and classes within a definition, but for the methods of a class at the top: inner_function, inner_class, inner_method, each with the name of what holds it and how many do. only: as in parse_python."""
    rows, open_ = [], _held(node)
    while open_:
        x = open_.pop()
        if not isinstance(x, _DEFINITIONS):
            open_ += _held(x)
            continue
        method = isinstance(node, ast.ClassDef) and not isinstance(x, ast.ClassDef)
        name = f"{full}.{x.name}"
        if not (method and depth == 0):
            kind = "inner_class" if isinstance(x, ast.ClassDef) else "inner_method" if method else "inner_function"
            row = {"name": x.name} if only and kind not in only else _class(x, path, want) if isinstance(x, ast.ClassDef) else _function(x, full if method else None, path, want)
            rows.append(row | {"kind": kind, "qualified_name": name, "depth": depth + 1, "parent": full})
        rows += _nested(x, name, depth + 1, path, want, only)
    return rows


#: Kinds of what is defined within functions and classes.
_INNER = frozenset(("inner_function", "inner_class", "inner_method"))


def parse_python(path: str, text: str, want: frozenset[str] = COLUMNS, only: frozenset[str] = frozenset()) -> list[dict]:
    """Rows of a module: itself, imports, constants, functions, classes and methods, type aliases, and what is defined within functions and classes.

    A text with syntax errors gives a row of kind error with the first of them and how many more there are, and all that is sound.
    want: columns that are read; what only others need may be left out of the rows. only: kinds that are read, all if none are
    named; rows of others are left out, or tell no more than what numbers the rest in order.
    """
    try:
        tree, errors = ast.parse(text), []
    except (SyntaxError, ValueError):
        tree, errors = recovered(text)
    made = lambda kind: not only or kind in only
    counted = "ord" in want
    inner = counted or not only or bool(only & _INNER)
    rows: list[dict] = [{"path": path, "kind": "error", "error": told(errors)}] if errors else []
    if not errors or sound(tree):
        first, full = _doc(tree) if want & _OF_DOC and made("module") else (None, None)
        rows.append({"path": path, "kind": "module", "name": path, "doc_first": first, "doc_full": full})
    function = lambda f, owner, kind: [_function(f, owner, path, want)] if made(kind) else [{"kind": kind, "parent": owner, "name": f.name}] * counted
    for node in tree.body:
        at = {"path": path, "start_line": node.lineno, "end_line": node.end_lineno}
        if isinstance(node, ast.Import):
            rows += [at | {"kind": "import", "module": n.name, "names": [], "alias": n.asname} for n in node.names]
        elif isinstance(node, ast.ImportFrom):
            module = "." * node.level + (node.module or "")
            plain = [n.name for n in node.names if not n.asname]
            rows += [at | {"kind": "import_from", "module": module, "names": plain, "alias": None}] * bool(plain)
            rows += [at | {"kind": "import_from", "module": module, "names": [n.name], "alias": n.asname} for n in node.names if n.asname]
        elif isinstance(node, _FUNCTIONS):
            rows += function(node, None, "function")
            rows += _nested(node, node.name, 0, path, want, only) if inner else []
        elif isinstance(node, ast.ClassDef):
            rows += [_class(node, path, want)] if made("class") else [{"kind": "class", "name": node.name}] * counted
            for f in node.body if counted or made("method") else ():
                if isinstance(f, _FUNCTIONS):
                    rows += function(f, node.name, "method")
            rows += _nested(node, node.name, 0, path, want, only) if inner else []
        elif isinstance(node, ast.TypeAlias):
            rows.append(at | {"kind": "type_alias", "name": node.name.id, "value": _text(node.value) if made("type_alias") else None})
        elif isinstance(node, ast.Assign | ast.AnnAssign):
            for t in [node.target] if isinstance(node, ast.AnnAssign) else node.targets:
                if isinstance(t, ast.Name) and re.fullmatch(r"[A-Z_][A-Z0-9_]*", t.id):
                    rows.append(at | {"kind": "constant", "name": t.id} | ({"value": _text(node.value), "return_type": _text(getattr(node, "annotation", None))} if made("constant") else {}))
    key = lambda r: (r["kind"], r.get("parent"), r["name"])
    last = {key(r): k for k, r in enumerate(rows) if r.get("name")}  # of a name defined twice the last counts
    rows = [r for k, r in enumerate(rows) if not r.get("name") or last[key(r)] == k]
    for k, r in enumerate(rows):
        r["ord"] = k
    return rows


Extractor = Callable[[str, str], list[dict]]

#: What makes rows of SYMBOLS of a file's path and text, by file name ending.
_extractors: dict[str, Extractor] = {".py": parse_python, ".pyi": parse_python}


def register_extractor(ending: str, extract: Extractor) -> None:
    """Have files with this ending (with its dot) parsed by a function of one's own; it takes the place of another."""
    _extractors[ending.lower()] = extract


def extractors() -> dict[str, Extractor]:
    """All that are known: registered ones, and the scanner for the languages that it reads."""
    scanned = {f".{end}": partial(scanner.scan_source, language) for end, language in LANGUAGES.items() if language in scanner.RULES}
    return scanned | _extractors


def rows_of(by_ending: dict[str, Extractor], path: str, text: str) -> list[dict]:
    """What the extractor of the path's ending finds; none for other endings; one error row if it fails."""
    extract = by_ending.get("." + path.rpartition(".")[2].lower())
    collects = gc.isenabled()
    gc.disable()  # a tree has no cycles, and looking for them takes as long as parsing
    try:
        return list(extract(path, text)) if extract else []
    except Exception as e:  # whatever an extractor raises is that file's row
        return [{"path": path, "kind": "error", "ord": 0, "error": f"{type(e).__name__}: {e}"}]
    finally:
        if collects:
            gc.enable()


def symbols_of_files(files: DataFrame, by_ending: dict[str, Extractor], columns: Iterable[str] = (), kinds: Iterable[str] = (), by_file: bool = False, types: dict[str, str] = _TYPES) -> DataFrame:
    """Everything that files with these endings define. A file whose extractor fails gives an error row, never a failed job.

    A task parses the files of one partition and holds a few thousand rows at a time. columns, kinds: those that are read, all if
    none are named; whole files are parsed all the same, but only these leave Python. by_file: one row for each file, path and the
    array symbols in order of ord, so what a file's symbols tell of each other needs no shuffle. types: of the columns, if there are others.
    """
    kept, only = list(columns) or list(types), frozenset(kinds)
    schema = pa.schema([(c, _arrow_type(types[c])) for c in kept])

    def made(rows: list[dict], paths: list[str], ends: list[int]) -> pa.RecordBatch:
        batch = _batch(rows, schema)
        if not by_file:
            return batch
        held = pa.StructArray.from_arrays(batch.columns, fields=list(schema))
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), held)], ["path", "symbols"])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, paths, ends = [], [], [0]
        for batch in batches:
            for p, t in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = rows_of(by_ending, p, t or "")
                rows += [r for r in found if r["kind"] in only] if only else found
                paths.append(p)
                ends.append(len(rows))
                if len(rows) >= ROWS or len(paths) >= ROWS:
                    yield made(rows, paths, ends)
                    rows, paths, ends = [], [], [0]
        yield made(rows, paths, ends)

    shown = f"path string, symbols array<struct<{','.join(f'{c}:{types[c]}' for c in kept)}>>" if by_file else ", ".join(f"{c} {types[c]}" for c in kept)
    return files.where(extension(F.col("path")).isin(*by_ending)).select("path", "text").mapInArrow(parse, shown)


def python_symbols(files: DataFrame, columns: Iterable[str] = (), kinds: Iterable[str] = (), by_file: bool = False) -> DataFrame:
    """Everything that Python files define. A file that can't be parsed gives an error row, never a failed job. columns, kinds, by_file: as in symbols_of_files."""
    columns, kinds = list(columns), list(kinds)
    parse = partial(parse_python, want=frozenset(columns) or COLUMNS, only=frozenset(kinds))
    return symbols_of_files(files, {".py": parse, ".pyi": parse}, columns, kinds, by_file)


#: What a row of kind call tells besides its caller's names and lines.
_CALL = {"callee": "string", "call_ord": "int", "call_count": "int", "dotted": "boolean", "lookup": "string", "type": "string", "target": "string", "sure": "boolean", "here_name": "string", "here_start": "int", "here_end": "int"}
_ATTRIBUTE = re.compile(r"(?:(?:self|cls)\.)?(\w+)", re.ASCII)


def _bare_type(annotation: str) -> str:
    """Optional, unions, generics and modules taken off, as graph.attribute_types does."""
    bare = re.sub(r"^(?:[\w.]*\.)?Optional\[(.*)\]$", r"\1", annotation, flags=re.ASCII)
    bare = re.sub(r"\[.*$", "", re.sub(r"\s*\|\s*None|None\s*\|\s*", "", bare, flags=re.ASCII))
    return bare.strip("'\" ").rpartition(".")[2]


def with_calls(rows: list[dict]) -> list[dict]:
    """The functions and methods among a file's rows, and a row of kind call for each of their calls with what the file alone tells of it.

    That is the name that it is looked up by, which is another where it is an alias, the type of the attribute and the imported file that
    it goes through, and the first function or method of that name in the file, which is sure if the own class holds it.
    """
    made = [r for r in rows if r["kind"] in ("function", "method")]
    targets, originals, types = {}, {}, {}
    for r in rows:
        if r["kind"] in ("import", "import_from"):
            target, alias = r["module"].lstrip(".").replace(".", "/") + ".py", r["alias"]
            targets |= dict.fromkeys([alias] if alias is not None else [r["module"].rpartition(".")[2]] if r["kind"] == "import" else r["names"], target)
            if alias is not None and r["kind"] == "import_from":
                originals[alias] = r["names"][0]
        elif r["kind"] == "class":
            for a in (*r["class_attrs"], *r["instance_attrs"]):
                if a["annotation"] is not None:
                    types.setdefault((r["name"], a["name"]), a["annotation"])
    first, of_class = {}, {}
    for r in sorted(made, key=lambda r: (r["class_name"] is not None, r["class_name"] or "", r["start_line"])):
        first.setdefault(r["name"], r)
        of_class.setdefault((r["class_name"], r["name"]), r)
    out = list(made)
    for r in made:
        cls = r["class_name"]
        for c in r["calls"]:
            prefix, dot, base = c["callee"].rpartition(".")
            lookup = base if dot else originals.get(base, base)
            own = of_class.get((cls, lookup)) if cls is not None and prefix in ("self", "cls") else None
            here = own or first.get(lookup, {})
            attr = _ATTRIBUTE.fullmatch(prefix) if dot and cls is not None else None
            type_ = types.get((cls, attr[1])) if attr else None
            out.append({
                "path": r["path"], "kind": "call", "name": r["name"], "qualified_name": r["qualified_name"], "start_line": r["start_line"], "end_line": r["end_line"], "callee": c["callee"], "call_ord": c["ord"], "call_count": c["n"], "dotted": bool(dot), "lookup": lookup,
                "type": None if type_ is None else _bare_type(type_), "target": targets.get(prefix if dot else base), "sure": own is not None, "here_name": here.get("qualified_name"), "here_start": here.get("start_line"), "here_end": here.get("end_line"),
            })
    return out


#: What calls are made of, and what is told of functions and methods for them.
_MADE, _OF_CALLS = ("path", "kind", "class_name", "name", "qualified_name", "start_line", "end_line"), ("calls", "module", "names", "alias", "class_attrs", "instance_attrs")


def python_calls(files: DataFrame, *more: str) -> DataFrame:
    """What with_calls gives of Python files; more: further columns of functions and methods."""
    parse = partial(parse_python, want=frozenset((*_MADE, *_OF_CALLS, *more)), only=frozenset(("function", "method", "class", "import", "import_from")))
    extract = lambda path, text: with_calls(parse(path, text))
    return symbols_of_files(files, {".py": extract, ".pyi": extract}, (*_MADE, *more, *_CALL), ("function", "method", "call"), types=_TYPES | _CALL)


def type_entries(symbols: DataFrame) -> DataFrame:
    """path, name, kind, start_line, shape of type-like classes and type aliases. Kinds go by priority."""
    base = lambda name: F.exists("bases", lambda b: F.element_at(F.split(b, r"[.\[]"), 1).eqNullSafe(name) | b.rlike(rf"(?:^|\.){name}(?:\[|$)"))
    kind = (
        F.when(F.exists("decorators", lambda d: d.rlike(r"(?:^|\.)dataclass$")), "dataclass").when(base("Protocol"), "protocol").when(base("TypedDict"), "typeddict").when(base("NamedTuple"), "namedtuple").when(base("BaseModel"), "pydantic").when(F.col("kind") == "type_alias", "type_alias")
    )
    fields = F.concat(F.coalesce("class_attrs", F.array().cast(f"array<{ATTR}>")), F.coalesce("instance_attrs", F.array().cast(f"array<{ATTR}>")))
    shape = F.when(F.col("kind") == "type_alias", F.concat_ws(" = ", "name", "value")).otherwise(F.concat(F.col("name"), F.lit("{"), F.array_join(F.transform(fields, lambda f: F.concat(f["name"], F.coalesce(F.concat(F.lit(":"), f["annotation"]), F.lit("")), F.coalesce(F.concat(F.lit("="), f["default_value"]), F.lit("")))), ", "), F.lit("}")))
    return symbols.where(F.col("kind").isin("class", "type_alias")).select("path", "name", kind.alias("type_kind"), "start_line", shape.alias("shape")).where("type_kind is not null")


RECORD = ("id", "path", "record_type", "language", "symbol", "title", "start_line", "end_line", "text")


def record(kind: str, path: Column, language: Column, symbol: Column, title: Column, start: Column, end: Column, *lines: Column) -> list[Column]:
    """Columns of an embedding record; lines that are null are left out of its text."""
    head = [F.concat(F.lit("File: "), path), F.concat(F.lit("Language: "), language)]
    key = F.concat(path, F.lit("::"), F.coalesce(symbol, F.lit(f"__{kind}__")))
    return [c.alias(n) for n, c in zip(RECORD, (key, path, F.lit(kind), language, symbol, title, start.cast("int"), end.cast("int"), F.concat_ws("\n", *head, *lines)), strict=True)]
