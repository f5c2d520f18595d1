"""Counts, outlines and texts of an index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodex.config import CLIP, SHOWN_ATTRIBUTES, SHOWN_CONSTANTS, SHOWN_ENTRIES, SHOWN_LINES, SHOWN_READS, SHOWN_TYPE_LINES, SHOWN_VALUE
from lodex.functions.paths import extension
from lodex.functions.text import file_one_liner, lines_of, one_liner
from lodex.sources.staging import large


def status(files: DataFrame, symbols: DataFrame, regions: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """One row of counts; extra: further aggregates over files by name."""
    more = [c.alias(n) for n, c in (extra or {}).items()]
    f = files.agg(F.count("*").alias("files"), F.array_sort(F.collect_set("language")).alias("languages"), *more)
    s = symbols.agg(F.count_if(F.col("kind").isin("function", "method")).alias("functions"), F.count_if(F.col("kind") == "class").alias("classes"), F.count_if(F.col("kind") == "error").alias("parse_errors"))
    return f.crossJoin(s).crossJoin(regions.agg(F.count("*").alias("regions")))  # a row each


def modes(files: DataFrame, symbols: DataFrame, endings: tuple[str, ...]) -> DataFrame:
    """mode, n: files with errors (error), of endings that a parser or scanner reads (parsed), and all others (lines)."""
    broken = symbols.where("kind = 'error'").select("path").distinct().withColumn("broken", F.lit(True))
    mode = F.when(F.col("broken"), "error").when(extension(F.col("path")).isin(*endings), "parsed").otherwise("lines")
    return files.select("path").join(broken, "path", "left").groupBy(mode.alias("mode")).agg(F.count("*").alias("n"))


def public_counts(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("path").agg(F.count_if(F.col("kind").isin("function", "method") & (F.col("visibility") == "public")).alias("public_fns"))


def overview(files: DataFrame, counts: DataFrame) -> DataFrame:
    """By top folder: files, public functions, and the first file's docstring."""
    top = F.when(F.col("path").contains("/"), F.split_part("path", F.lit("/"), F.lit(1))).otherwise(".")
    return files.join(large(counts), "path", "left").groupBy(top.alias("module")).agg(F.count("*").alias("files"), F.sum(F.coalesce("public_fns", F.lit(0))).alias("functions"), one_liner(F.min_by("docstring", F.when(F.col("docstring").isNotNull(), F.col("path"))), 80).alias("about"))


def type_lookup(symbols: DataFrame) -> DataFrame:
    """A row of each type name; of a name in several files the last path counts, in one file the last line."""
    last = F.struct("path", "start_line", "ord")
    return symbols.groupBy("name").agg(F.max_by(F.struct("path", "start_line", "type_kind", "shape"), last).alias("t")).select("name", "t.*")


def _joined(rows: DataFrame, keys: list[str], order: list[str], column: str, gap: str) -> DataFrame:
    """The column's texts of each key in order, as one text under the same name."""
    held = F.array_sort(F.collect_list(F.struct(*order, column)))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(held, lambda r: r[column]), gap).alias(column))


def shown_params(params: Column) -> Column:
    """a:T=1, b:?, *args, **kw"""
    star = lambda p: F.when(p["kw_variadic"], "**").when(p["variadic"], "*").otherwise("")
    kind = lambda p: F.coalesce(F.concat(F.lit(":"), p["annotation"]), F.when(p["variadic"] | p["kw_variadic"], "").otherwise(":?"))
    return F.array_join(F.transform(F.filter(params, lambda p: ~p["name"].isin("self", "cls")), lambda p: F.concat(star(p), p["name"], kind(p), F.when(p["has_default"], F.concat(F.lit("="), F.coalesce(p["default_value"], F.lit("")))).otherwise(""))), ", ")


def signature_line() -> Column:
    """[async ]name(params)->R[: one-liner] of a function's row."""
    name = F.concat(F.when(F.col("is_async"), "async ").otherwise(""), F.col("name"), F.lit("("), shown_params(F.col("params")), F.lit(")->"), F.coalesce("return_type", F.lit("None")))
    return F.concat(name, F.coalesce(F.concat(F.lit(": "), one_liner(F.col("doc_first"))), F.lit("")))


def tier1(symbols: DataFrame) -> DataFrame:
    """path, ord, line: one line per function: [async ]name(params)->R: one-liner  L1-9."""
    line = F.concat(signature_line(), F.lit("  L"), F.col("start_line"), F.lit("-"), F.col("end_line"))
    return symbols.where(F.col("kind").isin("function", "method")).select("path", "kind", "class_name", "name", "ord", "visibility", line.alias("line"))


def _has_base(*names: str) -> Column:
    return F.exists("bases", lambda b: b.isin(*names))


def _typed() -> Column:
    """Classes that are shown as types: their fields say all."""
    return F.exists("decorators", lambda d: d.rlike(r"(?:^|\.)dataclass$")) | _has_base("TypedDict", "NamedTuple", "BaseModel", "pydantic.BaseModel")


def _field(a: Column, unknown: str = "") -> Column:
    """name:type=default"""
    kind = F.coalesce(F.concat(F.lit(":"), a["annotation"]), F.lit(unknown))
    return F.concat(a["name"], kind, F.when(a["has_default"] & a["default_value"].isNotNull(), F.concat(F.lit("="), a["default_value"])).otherwise(""))


def _attributes() -> Column:
    none = F.array().cast("array<struct<name:string,annotation:string,has_default:boolean,default_value:string>>")
    return F.concat(F.coalesce("class_attrs", none), F.coalesce("instance_attrs", none))


def class_line() -> tuple[Column, Column]:
    """typed, line of a class's row: Name{field:type=default} of types, else class Name{attributes} [Protocol or Abstract]; then its docstring."""
    every = _attributes()
    fields = F.array_join(F.transform(every, lambda a: _field(a, ":?")), ", ")
    first, more = F.slice(F.transform(every, lambda a: _field(a)), 1, SHOWN_ATTRIBUTES), F.size(every) - SHOWN_ATTRIBUTES
    short = F.when(F.size(every) == 0, "").otherwise(F.concat(F.lit("{"), F.array_join(F.concat(first, F.when(more > 0, F.array(F.concat(F.lit("+"), more, F.lit(" more")))).otherwise(F.array().cast("array<string>"))), ", "), F.lit("}")))
    tag = F.when(_has_base("Protocol"), " [Protocol]").when(_has_base("ABC", "ABCMeta"), " [Abstract]").otherwise("")
    doc = F.coalesce(F.concat(F.lit(": "), "doc_first"), F.lit(""))
    typed = F.coalesce(_typed(), F.lit(False))
    return typed, F.when(typed, F.concat("name", F.lit("{"), fields, F.lit("}"), doc)).otherwise(F.concat(F.lit("class "), "name", short, tag, doc))


def import_line(plain: Column, named: Column) -> Column:
    """# imports: os, np | module: A,B as b; null without any. plain: rows with a line; named: rows with a module as owner, and names; both in order."""
    names = lambda m: F.array_distinct(F.flatten(F.transform(F.filter(named, lambda x: x["owner"] == m), lambda x: x["names"])))
    each = F.transform(F.array_distinct(F.transform(named, lambda x: x["owner"])), lambda m: F.concat(m, F.lit(": "), F.array_join(names(m), ",")))
    first = F.when(F.size(plain) > 0, F.array_join(F.transform(plain, lambda x: x["line"]), ", "))
    return F.when((F.size(plain) > 0) | (F.size(named) > 0), F.concat(F.lit("# imports: "), F.concat_ws(" | ", first, each)))


def constant_line(rows: Column) -> Column:
    """# consts: A=1, B=<str len=99>, +3 more; null without any. rows: with a line each, in order."""
    more = F.size(rows) - SHOWN_CONSTANTS
    return F.when(F.size(rows) > 0, F.concat(F.lit("# consts: "), F.array_join(F.transform(F.slice(rows, 1, SHOWN_CONSTANTS), lambda r: r["line"]), ", "), F.when(more > 0, F.concat(F.lit(", +"), more, F.lit(" more"))).otherwise("")))


def _shown_constant() -> Column:
    long = F.concat(F.when(F.col("value").rlike("^\\s*b['\"]"), "<bytes len=").otherwise("<str len="), F.length("value"), F.lit(">"))
    return F.concat("name", F.coalesce(F.concat(F.lit("="), F.when(F.length("value") > SHOWN_VALUE, long).otherwise(F.col("value"))), F.lit("")))


def outline(files: DataFrame, symbols: DataFrame, compact: bool = False) -> DataFrame:
    """path, text: header, imports and constants in a line each, public functions, then classes with their public methods.

    compact: names and line ranges only. A file that can't be parsed says so and no more. Each row's line is written where the
    row is read; a file's rows meet once, and its lines are put in order there.
    """
    kind, name = F.col("kind"), F.col("name")
    shown = kind.isin("function", "method") & (F.col("visibility") == "public") & ~((kind == "method") & name.startswith("__") & name.endswith("__"))
    span = F.concat(F.lit("L"), "start_line", F.lit("-"), "end_line")
    if compact:
        line, typed = F.concat_ws("  ", F.when(kind == "method", F.concat_ws(".", "class_name", "name")).otherwise(name), span), F.lit(False)
    else:
        typed, of_class = class_line()
        line = F.when(kind == "class", of_class).when(kind == "import", F.coalesce("alias", "module")).when(kind == "constant", _shown_constant()).when(shown, F.concat(signature_line(), F.lit("  "), span))
        names = F.when(kind == "import_from", F.when(F.col("alias").isNotNull(), F.transform("names", lambda n: F.concat(n, F.lit(" as "), "alias"))).otherwise(F.col("names")))
    owner = F.when(kind == "class", name).when(kind == "method", F.col("class_name"))
    read = shown | (kind == "class")
    if not compact:
        owner = owner.when(kind == "import_from", F.col("module"))
        read |= kind.isin("import", "constant") | (kind == "import_from") & F.col("module").isNotNull() & (F.size("names") > 0)
    row = F.struct("kind", "ord", owner.alias("owner"), F.when(kind == "class", typed).alias("typed"), line.alias("line"), (F.lit(None).cast("array<string>") if compact else names).alias("names"))
    public = kind.isin("function", "method") & (F.col("visibility") == "public")
    facts = symbols.select("path", row.alias("row"), read.alias("read"), public.alias("public"), F.when(kind == "module", F.col("doc_first")).alias("docstring"), F.when(kind == "error", F.col("error")).alias("wrong"))
    held = facts.groupBy("path").agg(F.count_if("public").alias("public_fns"), F.max("docstring").alias("docstring"), F.min("wrong").alias("wrong"), F.array_sort(F.collect_list(F.when(F.col("read"), F.col("row")))).alias("rows"))
    only = lambda k: F.filter("rows", lambda r: r["kind"] == k)
    held = held.select("path", "public_fns", "docstring", "wrong", *[only(k).alias(k) for k in ("import", "import_from", "constant", "class", "function", "method")])

    own = lambda m: F.filter("class", lambda c: c["owner"] == m["owner"])
    at = lambda m: F.coalesce(F.array_min(F.transform(own(m), lambda c: c["ord"])), m["ord"])
    methods = F.col("method") if compact else F.filter("method", lambda m: ~F.coalesce(F.exists(own(m), lambda c: c["typed"]), F.lit(False)))
    body = F.transform(methods, lambda m: F.struct(at(m).alias("ord"), m["ord"].alias("sub"), F.concat(F.lit("  " if compact else "    "), m["line"]).alias("line")))
    if not compact:
        body = F.concat(body, F.transform("class", lambda c: F.struct(c["ord"].alias("ord"), F.lit(-1).alias("sub"), F.concat(F.lit("  "), c["line"]).alias("line"))))
    lines = F.concat(F.transform("function", lambda f: F.concat(F.lit("  "), f["line"])), F.transform(F.array_sort(body), lambda r: r["line"]))
    said = [lines] if compact else [import_line(F.col("import"), F.col("import_from")), constant_line(F.col("constant")), lines]
    held = held.select("path", "public_fns", "docstring", "wrong", F.concat_ws("\n", *said).alias("lines"))

    head = F.concat("path", F.lit(" ["), F.coalesce("public_fns", F.lit(0)), F.lit("fn, "), "line_count", F.lit("L]"))
    head = head if compact else F.concat(head, F.lit(": "), file_one_liner(F.col("path"), F.col("docstring")))
    text = F.when(F.col("wrong").isNotNull(), F.concat("path", F.lit(" [PARSE ERROR]: "), "wrong")).otherwise(F.concat_ws("\n", head, F.nullif("lines", F.lit(""))))
    return files.select("path", "line_count").join(large(held), "path", "left").select("path", text.alias("text"))


def preview(files: DataFrame, symbols: DataFrame, parsed: Sequence[str]) -> DataFrame:
    """path, text of at most 4,000 characters: what a record says of a file.

    Of Python files their outline; of others whose ending is in parsed the first functions and classes with their lines; of
    the rest the first lines that aren't blank.
    """
    python, known = extension(F.col("path")).isin(".py", ".pyi"), extension(F.col("path")).isin(*parsed)
    outlined = outline(files.where(python), symbols.where(python)).select("path", F.col("text").alias("outlined"))
    entry = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("ord", F.concat(F.lit("- "), "name", F.lit("  L"), "start_line", F.lit("-"), "end_line").alias("x")))))
    listed = symbols.where(~python & F.col("kind").isin("function", "class")).groupBy("path").agg(entry("function").alias("fns"), entry("class").alias("types"))
    several = lambda c: F.coalesce(F.size(c), F.lit(0))
    part = lambda label, c: F.when(several(c) > 0, F.concat_ws("\n", F.lit(f"## {label}"), F.transform(F.slice(c, 1, SHOWN_ENTRIES), lambda r: r["x"])))
    counts = F.concat(F.lit("# "), "path", F.lit("  ("), several("fns"), F.lit(" functions, "), several("types"), F.lit(" classes)"))
    lines = F.filter(F.transform(F.slice(lines_of(F.col("text")), 1, SHOWN_LINES), lambda x: F.regexp_replace(x, r"\s+$", "")), lambda x: x != "")
    said = F.when(python, F.col("outlined")).when(known, F.concat_ws("\n", counts, part("Functions", "fns"), part("Classes", "types"))).otherwise(F.array_join(lines, "\n"))
    shown = files.select("path", "text").join(large(outlined), "path", "left").join(large(listed), "path", "left").select("path", said.alias("text"))
    return shown.withColumn("text", F.when(F.length("text") > CLIP, F.concat(F.substring("text", 1, CLIP), F.lit("\n... (truncated)"))).otherwise(F.col("text")))


def compressed_imports(symbols: DataFrame) -> DataFrame:
    """path, module, names in order without repeats."""
    each = symbols.where("kind = 'import_from'").select("path", "module", "ord", F.posexplode("names").alias("pos", "name"))
    return each.groupBy("path", "module").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", "pos", "name"))), lambda r: r["name"])).alias("names"))


def _range(start: str, end: str) -> Column:
    return F.coalesce(F.concat(F.lit(":L"), start, F.lit("-"), end), F.lit(""))


def tier2(symbols: DataFrame, resolved: DataFrame, callers: DataFrame | None = None) -> DataFrame:
    """path, qualified_name, text: what it depends on, who calls it, decorators and raises, what is unresolved, and what to read next.

    Each row's line is written where the row is read; all lines of a function or method meet in one grouping. callers: reverse edges
    (graph.callers); without them they are read off the calls in the same pass: of callers of one name in one file the first counts.
    """
    key = ["path", "qualified_name"]
    note = F.when((F.col("confidence") == "ambiguous") & (F.col("match_count") > 1), F.concat(F.lit("  [ambiguous: "), "match_count", F.lit(" matches; verify source]"))).when((F.col("confidence") == "preferred") & (F.col("match_count") > 1), F.concat(F.lit("  [preferred among "), "match_count", F.lit(" matches]"))).otherwise("")
    decorators = F.when(F.size("decorators") > 0, F.concat(F.lit("  decorators: "), F.array_join(F.transform("decorators", lambda d: F.concat(F.lit("@"), d)), ", ")))
    raised = F.when(F.size("raises") > 0, F.concat(F.lit("  raises: "), F.array_join("raises", ", ")))
    entry = lambda what, text, **more: F.struct(F.lit(what).alias("what"), *[more.get(n, F.lit(None)).cast(t).alias(n) for n, t in (("at", "string"), ("who", "string"), ("line", "int"), ("ord", "int"), ("name", "string"))], text.alias("text"), more.get("more", F.lit(None)).cast("string").alias("more"))
    head = F.concat(F.lit("context for "), "qualified_name", F.lit(" in "), "path", _range("start_line", "end_line"))
    heads = symbols.where(F.col("kind").isin("function", "method")).select(*key, entry("head", head, more=F.concat_ws("\n", decorators, raised)).alias("e"))

    read = F.when(F.col("to_path") != F.col("path"), F.concat(F.lit("  function_read('"), "to_path", F.lit("', '"), "to_name", F.lit("')")))
    depends = entry("depends_on", F.concat(F.lit("  "), "to_name", F.lit("  "), "to_path", _range("to_start", "to_end"), note), ord=F.col("call_ord"), more=read)
    unresolved = entry("unresolved", F.concat(F.lit("  "), "callee", F.lit(": could not resolve statically")), ord=F.col("call_ord"))
    back = lambda at, **more: entry("called_by", F.concat(F.lit("  "), "caller", F.lit("  "), at, _range("start_line", "end_line")), at=F.col(at), who=F.col("caller_name"), line=F.col("start_line"), name=F.col("caller"), **more)
    sides = F.when(F.col("is_external") | F.lit(callers is not None), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    turn = lambda to, own: F.when(F.col("back"), F.col(to)).otherwise(F.col(own))
    of_call = F.when(F.col("back"), back("path", ord=F.col("call_ord"))).when(F.col("is_external"), unresolved).otherwise(depends)
    lines = resolved.select("*", F.explode(sides).alias("back")).select(turn("to_path", "path").alias("path"), turn("to_name", "caller").alias("qualified_name"), of_call.alias("e"))
    if callers is not None:
        lines = lines.unionByName(callers.select(F.col("to_path").alias("path"), F.col("to_name").alias("qualified_name"), back("caller_path").alias("e")))
    held = heads.unionByName(lines).groupBy(*key).agg(F.collect_list("e").alias("es"))

    only = lambda what: F.filter("es", lambda e: e["what"] == what)
    texts = lambda rows, *order, text="text": F.array_join(F.transform(F.array_sort(F.transform(rows, lambda e: F.struct(*[e[x].alias(x) for x in (*order, text)]))), lambda e: e[text]), "\n")
    calling = F.array_sort(F.transform(only("called_by"), lambda e: F.struct(*[e[x].alias(x) for x in ("at", "who", "line", "ord", "name", "text")])))
    held = held.select(*key, only("head").alias("heads"), only("depends_on").alias("depends"), only("unresolved").alias("unresolved"), calling.alias("calling")).where(F.size("heads") > 0)
    once = F.filter("calling", lambda e, n: (n == 0) | ~(e["at"].eqNullSafe(F.get("calling", n - 1)["at"]) & e["who"].eqNullSafe(F.get("calling", n - 1)["who"])))
    reads = F.transform(F.slice(F.array_sort(F.transform(F.filter("depends", lambda e: e["more"].isNotNull()), lambda e: F.struct(e["ord"].alias("ord"), e["more"].alias("more")))), 1, SHOWN_READS), lambda e: e["more"])
    told = {"depends_on": texts(F.col("depends"), "ord"), "called_by": texts(once, "at", "name"), "flags": F.col("h.more"), "unresolved": texts(F.col("unresolved"), "ord"), "suggested_reads": F.array_join(reads, "\n")}
    shown = held.select(*key, F.explode("heads").alias("h"), *[told[c].alias(c) for c in told if c != "flags"]).withColumn("flags", F.col("h.more"))
    part = lambda label: F.when(F.coalesce(F.col(label), F.lit("")) != "", F.concat(F.lit(f"\n{label}:\n"), F.col(label)))
    return shown.select(*key, F.concat_ws("\n", "h.text", *map(part, told)).alias("text"))


def type_shapes(symbols: DataFrame, methods: bool = True) -> DataFrame:
    """path, name, start_line, end_line, bases, fields, methods, text of every class; methods: those that are public, in order."""
    cls = symbols.where("kind = 'class'")
    fields = F.transform(_attributes(), lambda a: F.concat(a["name"], F.coalesce(F.concat(F.lit(": "), a["annotation"]), F.lit(""))))
    listed = F.array_join(F.transform(_attributes(), lambda a: _field(a, ":?")), ", ")
    tags = F.concat_ws(", ", F.when(F.exists("decorators", lambda d: d.rlike(r"(?:^|\.)dataclass$")), "dataclass"), F.when(_has_base("Protocol"), "Protocol"), F.when(_has_base("ABC", "ABCMeta"), "abstract"))
    head = F.concat("name", F.lit(" ("), "path", F.lit(", line "), "start_line", F.lit("):"))
    lines = [head, F.when(tags != "", F.concat(F.lit("  ["), tags, F.lit("]"))), F.concat(F.lit('  "'), "doc_first", F.lit('"')), F.when(F.size("bases") > 0, F.concat(F.lit("  bases: "), F.array_join("bases", ", "))), F.when(listed != "", F.concat(F.lit("  fields: "), listed))]
    out = cls.select("path", "name", "start_line", "end_line", "bases", fields.alias("fields"), F.concat_ws("\n", *lines).alias("text"))
    if not methods:
        return out
    own = tier1(symbols).where("kind = 'method' and visibility = 'public'").groupBy("path", F.col("class_name").alias("name")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda r: r["line"]).alias("methods"))
    told = F.concat(F.lit("  methods:\n"), F.array_join(F.transform("methods", lambda m: F.concat(F.lit("    "), m)), "\n"))
    return out.join(large(own), ["path", "name"], "left").withColumn("text", F.concat_ws("\n", "text", told))


def type_shape(symbols: DataFrame, name: str, methods: bool = True) -> DataFrame:
    """Classes of this name with bases, fields and, if asked for, public methods."""
    return type_shapes(symbols.where((F.col("kind") == "class") & (F.col("name") == name) | (F.col("class_name") == name)), methods)


def types_text(types: DataFrame) -> DataFrame:
    """name, text: what an overview says of each type: name, kind, place, and the first lines of its shape."""
    shape = F.array_join(F.transform(F.slice(F.split("shape", "\n"), 1, SHOWN_TYPE_LINES), lambda x: F.concat(F.lit("    "), x)), "\n")
    return types.select("name", F.concat(F.lit("  "), "name", F.lit(" ["), "type_kind", F.lit("] ("), "path", F.lit(", line "), "start_line", F.lit(")\n"), shape).alias("text"))


def found(rows: DataFrame, path: str, name: str | None = None) -> DataFrame:
    """rows with a column text, or, if there are none, one row that says what wasn't found."""
    message = f"Symbol {name} not found in {path}." if name else f"File {path} not found in the index."
    said = rows.sparkSession.range(1).select(F.lit(message).alias("text"))
    none = rows.limit(1).agg(F.count("*").alias("n"))
    return rows.unionByName(said.crossJoin(none).where("n = 0").drop("n"), allowMissingColumns=True)  # a row each
