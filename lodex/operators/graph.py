"""The call graph: resolving calls, reverse edges, and bounded traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodex.sources.staging import FEW, few, large, stage

#: Kinds of rows that have a source of their own.
DEFINED = ("function", "method", "class", "inner_function", "inner_method", "inner_class")
RANKS = {"ambiguous": 0, "preferred": 1, "exact": 2}


def locators(symbols: DataFrame) -> DataFrame:
    """Where each function or method is; `ord` settles which one is first."""
    return symbols.where(F.col("kind").isin("function", "method")).select("name", F.col("path").alias("l_path"), F.col("class_name").alias("l_class"), F.col("qualified_name").alias("l_qn"), F.col("start_line").alias("l_start"), F.col("end_line").alias("l_end"), F.struct("path", F.col("class_name").isNotNull(), F.coalesce("class_name", F.lit("")), "ord").alias("l_ord"))


def import_maps(symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, local, target file) of imported names, of repeated ones the last; and (path, alias, original)."""
    imports = symbols.where(F.col("kind").isin("import", "import_from"))
    target = F.concat(F.translate(F.regexp_replace("module", r"^\.+", ""), ".", "/"), F.lit(".py"))
    local = F.explode(F.when(F.col("alias").isNotNull(), F.array("alias")).when(F.col("kind") == "import", F.array(F.element_at(F.split("module", r"\."), -1))).otherwise(F.col("names")))
    named = imports.select("path", local.alias("local"), target.alias("target"), "ord").groupBy("path", "local").agg(F.max_by("target", "ord").alias("target"))
    aliases = imports.where("kind = 'import_from' and alias is not null").select("path", "alias", F.col("names")[0].alias("original"), "ord").groupBy("path", "alias").agg(F.max_by("original", "ord").alias("original"))
    return named, aliases


def attribute_types(symbols: DataFrame) -> DataFrame:
    """(path, class, attribute, type) with Optional, unions, generics and modules taken off."""
    attrs = symbols.where("kind = 'class'").select("path", F.col("name").alias("cls"), F.explode(F.concat("class_attrs", "instance_attrs")).alias("a")).where("a.annotation is not null")
    bare = F.regexp_replace("a.annotation", r"^(?:[\w.]*\.)?Optional\[(.*)\]$", "$1")
    bare = F.regexp_replace(F.regexp_replace(bare, r"\s*\|\s*None|None\s*\|\s*", ""), r"\[.*$", "")
    return attrs.select("path", "cls", F.col("a.name").alias("attr"), F.element_at(F.split(F.trim(bare, F.lit("'\" ")), r"\."), -1).alias("type")).dropDuplicates(["path", "cls", "attr"])


def _aliases(symbols: Column) -> Column:
    """Of a file's symbols in order (symbols.python_symbols by file) the imports with an alias."""
    return F.filter(symbols, lambda s: (s["kind"] == "import_from") & s["alias"].isNotNull())


def called_names(files: DataFrame) -> DataFrame:
    """lookup, callee, calls: how many functions call a name, and the name that it is looked up by, which is another where it is an alias; and, with a null callee, the names that functions and methods have.

    files: path and symbols in order, of kinds function, method and import_from. A file's aliases and calls lie in one row, so
    nothing moves before it is counted, and a name that is called very often is one row.
    """
    defines = F.filter("symbols", lambda s: s["kind"].isin("function", "method"))
    held = files.select(defines.alias("defines"), _aliases(F.col("symbols")).alias("aliases"))
    original = lambda name: F.try_element_at(F.filter("aliases", lambda a: a["alias"] == name), F.lit(-1))["names"][0]
    lookup = lambda callee: F.when(callee.contains("."), F.substring_index(callee, ".", -1)).otherwise(F.coalesce(original(callee), callee))
    calls = F.flatten(F.filter(F.transform("defines", lambda s: s["calls"]), lambda c: c.isNotNull()))
    called = F.transform(calls, lambda c: F.struct(lookup(c["callee"]).alias("lookup"), c["callee"].alias("callee")))
    names = F.transform("defines", lambda s: F.struct(s["name"].alias("lookup"), F.lit(None).cast("string").alias("callee")))
    return held.select(F.explode_outer(F.concat(called, names)).alias("c")).select("c.*").where("lookup is not null").groupBy("lookup", "callee").agg(F.count("*").alias("calls"))


def external(called: DataFrame) -> DataFrame:
    """callee, calls of called_names: those that lead to no function or method."""
    known = called.where("callee is null").select("lookup")
    return called.where("callee is not null").join(large(known), "lookup", "left_anti").groupBy("callee").agg(F.sum("calls").alias("calls"))


def _least(found: DataFrame, keys: list[str], into: str, *more: Column) -> DataFrame:
    """The first locator of each key."""
    return found.groupBy(*keys).agg(F.min_by(F.struct("l_path", "l_qn", "l_start", "l_end", "l_ord"), "l_ord").alias(into), *more)


def suffix_matches(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """(lookup, target, in_target): of each wanted (lookup, target) the first locator whose path is the target, or ends with it, or that the target ends with.

    Both sides are joined by equality: paths and targets by every tail of whole segments, as many rows as a path has segments.
    """
    tails = lambda c: F.transform(F.split(c, "/"), lambda _, n: F.array_join(F.slice(F.split(c, "/"), n + 1, F.lit(1 << 30)), "/"))
    by_tail = found.select("lookup", F.explode(tails(F.col("l_path"))).alias("target"), "l_path", "l_qn", "l_start", "l_end", "l_ord")
    long = wanted.select("lookup", "target", F.explode(tails(F.col("target"))).alias("l_path")).join(large(found), ["lookup", "l_path"])
    short = wanted.join(large(by_tail), ["lookup", "target"])
    return _least(short.unionByName(long.select(short.columns)), ["lookup", "target"], "in_target")


def file_imports(symbols: Column) -> tuple[Column, Column]:
    """What import_maps gives, of a file's symbols in order: an array of (local, target), of repeated ones the last counts, and the originals of its aliases."""
    imports = F.filter(symbols, lambda s: s["kind"].isin("import", "import_from"))
    target = lambda s: F.concat(F.translate(F.regexp_replace(s["module"], r"^\.+", ""), ".", "/"), F.lit(".py"))
    local = lambda s: F.when(s["alias"].isNotNull(), F.array(s["alias"])).when(s["kind"] == "import", F.array(F.substring_index(s["module"], ".", -1))).otherwise(s["names"])
    named = F.flatten(F.transform(imports, lambda s: F.transform(local(s), lambda x: F.struct(x.alias("local"), target(s).alias("target")))))
    aliased = _aliases(symbols)
    last = lambda alias: F.element_at(F.filter(aliased, lambda s: s["alias"] == alias), -1)["names"][0]
    return named, F.transform(F.array_distinct(F.transform(aliased, lambda s: s["alias"])), last)


def suffix_paths(wanted: DataFrame, names: DataFrame) -> DataFrame:
    """(lookup, target, to_path): the path that suffix_matches finds, from the names of each file (l_path, lookups) alone.

    One join: whole targets meet tails of paths, and tails of targets meet whole paths. Keys begin with a number, so rows are sorted by it.
    """
    tails = lambda c: F.transform(F.split(c, "/"), lambda _, n: F.array_join(F.slice(F.split(c, "/"), n + 1, F.lit(1 << 30)), "/"))
    key = lambda at, whole: F.struct(at.alias("at"), F.lit(whole).alias("whole"))
    keys = lambda at, whole: F.explode_outer(F.concat(F.transform(tails(F.col(at)), lambda t: key(t, whole)), F.array(key(F.col(at), not whole)))).alias("k")
    numbered = lambda rows: rows.select("*", F.xxhash64("lookup", "k.at", "k.whole").alias("number"), "k.at", "k.whole").drop("k")
    by_key = names.select("l_path", "lookups", keys("l_path", False)).select("l_path", "k", F.explode_outer("lookups").alias("lookup"))
    joined = numbered(wanted.select("*", keys("target", True))).join(large(numbered(by_key)), ["number", "lookup", "at", "whole"])
    return joined.groupBy("lookup", "target").agg(F.min("l_path").alias("to_path"))


def resolve_calls(symbols: DataFrame) -> DataFrame:
    """A row per caller and callee name: where it leads, how sure that is, and how many symbols have the name.

    Of all symbols of the called name the one with the least (priority, order) is taken: the only one of its name, then one of
    the own class, of the attribute's class, of the own file, of the imported file, and any. Calls without one are external.
    The first locator is found by name, by name and class, by name and file, and so on, beforehand; calls are joined to
    these one by one, so a name that is defined and called very often doesn't multiply.
    """
    made = symbols.where(F.col("kind").isin("function", "method")).select("path", F.col("qualified_name").alias("caller"), F.col("name").alias("caller_name"), F.col("class_name").alias("cls"), "start_line", "end_line", F.explode("calls").alias("c"))
    callee = F.col("c.callee")
    calls = made.select("*", callee.alias("callee"), F.col("c.ord").alias("call_ord"), F.col("c.n").alias("call_count"), F.when(callee.contains("."), F.regexp_extract(callee, r"^(.*)\.", 1)).alias("prefix"), F.element_at(F.split(callee, r"\."), -1).alias("base")).drop("c")
    named, aliases = import_maps(symbols)
    calls = calls.join(large(aliases.select("path", F.col("alias").alias("base"), "original")), ["path", "base"], "left").withColumn("lookup", F.when(F.col("prefix").isNull(), F.coalesce("original", "base")).otherwise(F.col("base")))
    calls = calls.withColumn("local", F.coalesce("prefix", "base")).join(large(named), ["path", "local"], "left")
    attr = F.when(F.col("prefix").rlike(r"^(?:(?:self|cls)\.)?\w+$"), F.regexp_replace("prefix", r"^(?:self|cls)\.", ""))
    calls = calls.withColumn("attr", attr).join(large(attribute_types(symbols)), ["path", "cls", "attr"], "left")
    found = locators(symbols).withColumnRenamed("name", "lookup")
    any_ = _least(found, ["lookup"], "any_one", F.count("*").alias("matches"))
    of_class = found.where("l_class is not null")
    own_class = _least(of_class.withColumnRenamed("l_class", "cls").withColumn("path", F.col("l_path")), ["lookup", "path", "cls"], "own_class")
    of_type = _least(of_class.withColumnRenamed("l_class", "type"), ["lookup", "type"], "of_type")
    same_file = _least(found.withColumn("path", F.col("l_path")), ["lookup", "path"], "same_file")
    in_target = suffix_matches(calls.where("target is not null").select("lookup", "target").distinct(), found)
    joined = calls.join(large(any_), "lookup", "left").join(large(own_class), ["lookup", "path", "cls"], "left").join(large(of_type), ["lookup", "type"], "left").join(large(same_file), ["lookup", "path"], "left").join(large(in_target), ["lookup", "target"], "left")
    own = F.col("own_class").isNotNull() & F.coalesce(F.col("prefix").isin("self", "cls"), F.lit(False))
    rules = [(F.col("matches") == 1, "any_one", "exact"), (own, "own_class", "exact"), (F.col("of_type").isNotNull(), "of_type", "exact"), (F.col("same_file").isNotNull(), "same_file", "preferred"), (F.col("in_target").isNotNull(), "in_target", "preferred"), (F.col("prefix").isNotNull() & F.col("target").isNotNull(), "any_one", "preferred")]
    external = F.col("any_one").isNull()
    where, sure = F.when(external, F.col("any_one")), F.when(external, "exact")
    for holds, column, how in rules:
        where, sure = where.when(holds, F.col(column)), sure.when(holds, how)
    best = joined.withColumn("r", where.otherwise(F.col("any_one"))).withColumn("confidence", sure.otherwise("ambiguous"))
    return best.select("path", "caller", "caller_name", "start_line", "end_line", "callee", "call_ord", "call_count", F.col("r.l_path").alias("to_path"), F.col("r.l_qn").alias("to_name"), F.col("r.l_start").alias("to_start"), F.col("r.l_end").alias("to_end"), external.alias("is_external"), "confidence", F.coalesce("matches", F.lit(0)).alias("match_count"))


#: Names that more than one call of so many goes by are sent to all tasks.
HOT = 1000


def resolve_files(rows: DataFrame) -> DataFrame:
    """What resolve_calls gives, of symbols.python_calls at rest.

    A name that very many calls go by is one row, sent to all tasks. Of what is left only a call's open questions move: which
    symbol has the name, the name in that class, the name in that file. They meet the symbols in one join, and the answers their call in one grouping.
    """
    calls = rows.where("kind = 'call'").select("path", F.col("qualified_name").alias("caller"), F.col("name").alias("caller_name"), "start_line", "end_line", "callee", "call_ord", "call_count", "dotted", "lookup", "type", "target", "sure", "here_name", "here_start", "here_end")
    made = rows.where("kind <> 'call'")
    locator = F.struct("path", F.col("class_name").isNotNull().alias("held"), F.coalesce("class_name", F.lit("")).alias("holder"), "start_line", "qualified_name", "end_line")
    typed, aims = F.col("type").isNotNull() & ~F.col("sure"), F.col("target").isNotNull() & F.col("here_name").isNull()
    counts = calls.groupBy("lookup").agg(F.count("*").alias("n"), F.max(typed).alias("typed"), F.max(aims).alias("aims"))
    any_ = made.groupBy(F.col("name").alias("lookup")).agg(F.min(locator).alias("any_one"), F.count("*").alias("matches"))
    names = stage(counts.join(large(any_), "lookup", "left").withColumn("matches", F.coalesce("matches", F.lit(0))), "names")
    many = (names.agg(F.sum("n")).first()[0] or 0) // HOT
    known = calls.join(F.broadcast(names.where(F.col("n") > many).select("lookup", "any_one", "matches")), "lookup", "left")
    settled = F.coalesce((F.col("matches") <= 1) | F.col("matches").isNotNull() & ~typed & ~aims, F.lit(False))

    none = F.array().cast("array<struct<what:string,at:string>>")
    ask = lambda what, at: F.struct(F.lit(what).alias("what"), at.alias("at"))
    tails = lambda c: F.transform(F.split(c, "/"), lambda _, n: F.array_join(F.slice(F.split(c, "/"), n + 1, F.lit(1 << 30)), "/"))
    into = lambda target: F.concat(F.array(ask("ends", target)), F.transform(F.slice(tails(target), 2, F.lit(1 << 30)), lambda t: ask("is", t)))
    asked = F.concat(F.when(F.col("matches").isNull(), F.array(ask("name", F.lit("")))).otherwise(none), F.when(typed, F.array(ask("class", F.col("type")))).otherwise(none), F.when(aims, into(F.col("target"))).otherwise(none))
    numbered = lambda rows: rows.select(F.xxhash64("lookup", "q.what", "q.at").alias("number"), "*", "q.what", "q.at").drop("q")
    told = ("caller_name", "start_line", "end_line", "callee", "call_count", "dotted", "sure", "here_name", "here_start", "here_end", "any_one", "matches")
    told = F.struct(*told, F.col("target").isNotNull().alias("aims"))
    open_ = known.where(~settled).select("path", "caller", "call_ord", "lookup", told.alias("told"), F.posexplode(asked).alias("nth", "q")).withColumn("told", F.when(F.col("nth") == 0, F.col("told"))).drop("nth")
    of = lambda flag: names.where(flag).select(F.col("lookup").alias("name"))
    only = lambda flag: made.join(F.broadcast(of(flag)), "name", "left_semi") if of(flag).count() <= FEW else made
    of_class = only("typed").where("class_name is not null").select(F.col("name").alias("lookup"), ask("class", F.col("class_name")).alias("q"), locator.alias("at_"))
    of_file = only("aims").select(F.col("name").alias("lookup"), F.explode(F.concat(F.transform(tails(F.col("path")), lambda t: ask("ends", t)), F.array(ask("is", F.col("path"))))).alias("q"), locator.alias("at_"))
    given = numbered(of_class.unionByName(of_file)).groupBy("number", "lookup", "what", "at").agg(F.min("at_").alias("found")).withColumn("n", F.lit(None).cast("long"))
    rare = numbered(names.where(F.col("n") <= many).select("lookup", ask("name", F.lit("")).alias("q"), F.col("any_one").alias("found"), F.col("matches").alias("n")))
    answers = numbered(open_).join(large(stage(given.unionByName(rare.select(given.columns)), "given")), ["number", "lookup", "what", "at"], "left")
    least = lambda *what: F.min(F.when(F.col("what").isin(*what), F.col("found")))
    met = answers.groupBy(F.xxhash64("path", "caller", "call_ord").alias("number"), "path", "caller", "call_ord").agg(F.max("told").alias("t"), least("name").alias("rare_one"), F.max("n").alias("n"), least("class").alias("of_type"), least("ends", "is").alias("in_target"))
    met = met.select("path", "caller", "call_ord", "t.*", "rare_one", "n", "of_type", "in_target").withColumns({"any_one": F.coalesce("any_one", "rare_one"), "matches": F.coalesce("matches", "n", F.lit(0))}).drop("rare_one", "n")
    null = F.lit(None).cast(met.schema["of_type"].dataType)
    ready = known.where(settled).withColumns({"aims": F.col("target").isNotNull(), "of_type": null, "in_target": null}).select(met.columns)
    return _best(ready).unionByName(_best(met))


def _best(calls: DataFrame) -> DataFrame:
    """The rows of resolve_files, of calls with the first locator of the name, of the class's, of the file's own and of the imported file."""
    far = lambda c: F.when(F.col(c).isNotNull(), F.struct(*[F.col(f"{c}.{x}").alias(x) for x in ("path", "qualified_name", "start_line", "end_line")]))
    here = F.struct("path", F.col("here_name").alias("qualified_name"), F.col("here_start").alias("start_line"), F.col("here_end").alias("end_line"))
    external = F.col("any_one").isNull()
    rules = [(external, far("any_one"), "exact"), (F.col("matches") == 1, far("any_one"), "exact"), (F.col("sure"), here, "exact"), (F.col("of_type").isNotNull(), far("of_type"), "exact"), (F.col("here_name").isNotNull(), here, "preferred"), (F.col("in_target").isNotNull(), far("in_target"), "preferred"), (F.col("dotted") & F.col("aims"), far("any_one"), "preferred")]
    where, sure = F, F
    for holds, place, how in rules:
        where, sure = where.when(holds, place), sure.when(holds, how)
    best = calls.withColumn("r", where.otherwise(far("any_one"))).withColumn("confidence", sure.otherwise("ambiguous"))
    return best.select("path", "caller", "caller_name", "start_line", "end_line", "callee", "call_ord", "call_count", F.col("r.path").alias("to_path"), F.col("r.qualified_name").alias("to_name"), F.col("r.start_line").alias("to_start"), F.col("r.end_line").alias("to_end"), external.alias("is_external"), "confidence", F.col("matches").alias("match_count"))


def callers(resolved: DataFrame) -> DataFrame:
    """Reverse edges; of callers of one name in one file the first counts."""
    return resolved.where(~F.col("is_external")).groupBy("to_path", "to_name", "caller_name", F.col("path").alias("caller_path")).agg(F.min_by(F.struct("caller", "start_line", "end_line", "confidence"), F.struct("start_line", "call_ord")).alias("c")).select("to_path", "to_name", "caller_name", "caller_path", "c.*")


def trace(edges: DataFrame, roots: DataFrame, depth: int = 2) -> DataFrame:
    """node, depth: nodes within 1 to 3 steps of the roots along (src, dst), each at its least depth; roots left out."""
    seen = roots.select("node").distinct().withColumn("depth", F.lit(0))
    front = seen
    for d in range(1, max(1, min(3, depth)) + 1):
        front = edges.join(front.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(front)
    return seen.where("depth > 0")


def calls_from(symbols: DataFrame, front: DataFrame) -> DataFrame:
    """What resolve_calls gives of the calls of a front (path, name) alone.

    All symbols are read, and kept are those of the front's files and the functions and methods of every file that have a name
    called from there, so names are counted and ranked as among all.
    """
    mine = F.col("kind").isin("function", "method")
    mark = lambda rows, *keys, flag: few(stage(rows.select(*keys).distinct(), flag)).withColumn(flag, F.lit(True))
    files = mark(front, "path", flag="near")
    near = symbols.join(files, "path", "left").join(mark(front, "path", F.col("name").alias("qualified_name"), flag="asked"), ["path", "qualified_name"], "left")
    near = stage(near.where("near").withColumn("calls", F.when(F.col("asked") & mine, F.col("calls"))).select(symbols.columns), "near")
    called = near.select(F.explode("calls").alias("c")).select(F.element_at(F.split("c.callee", r"\."), -1).alias("name"))
    original = near.where("kind = 'import_from' and alias is not null").select(F.col("names")[0].alias("name"))
    named = symbols.where(mine).join(mark(called.unionByName(original).where("name is not null"), "name", flag="named"), "name").drop("named")
    far = named.join(files, "path", "left").where("near is null").withColumn("calls", F.lit(None).cast(symbols.schema["calls"].dataType))
    return resolve_calls(stage(near.unionByName(far.select(symbols.columns)), "held"))


def trace_calls(symbols: DataFrame, roots: DataFrame, depth: int = 2) -> DataFrame:
    """path, name, depth: what trace finds along the calls from the roots (path, name). A step resolves the calls of what the last one reached, so no other call is joined or written."""
    seen = front = stage(roots.select("path", "name").distinct().withColumn("depth", F.lit(0)), "front")
    for d in range(1, max(1, min(3, depth)) + 1):
        reached = calls_from(symbols, front).where("not is_external").select(F.col("to_path").alias("path"), F.col("to_name").alias("name")).distinct()
        front = stage(reached.join(few(seen.select("path", "name")), ["path", "name"], "left_anti").withColumn("depth", F.lit(d)), "front")
        seen = seen.unionByName(front)
    return seen.where("depth > 0")


def ordered_trace(edges: DataFrame, roots: DataFrame, depth: int = 2) -> DataFrame:
    """root, node, depth, nth, parent, via: nodes within 1 to 3 steps of each root (root, node) along edges (src, dst, ord), as a breadth-first search finds them.

    A node is found once, from the parent that came first, of several edges of a parent by ord and then dst; nth counts from 1, and via are the
    nodes from the root to the parent. Each step is a join of all roots' fronts at once; nth is numbered within a root.
    """
    step = F.struct("ord", F.col("dst").alias("at"))
    seen = roots.select("root", "node").distinct().withColumns({"depth": F.lit(0), "key": F.array().cast(edges.select(F.array(step).alias("k")).schema["k"].dataType), "parent": F.lit(None).cast(edges.schema["dst"].dataType), "via": F.array().cast(edges.select(F.array("dst").alias("k")).schema["k"].dataType)})
    front = seen
    for d in range(1, max(1, min(3, depth)) + 1):
        reached = edges.join(front.select("root", F.col("node").alias("src"), "key", "via"), "src").select("root", F.col("dst").alias("node"), F.struct(F.concat("key", F.array(step)).alias("key"), F.col("src").alias("parent"), F.concat("via", F.array("src")).alias("via")).alias("w"))
        first = reached.groupBy("root", "node").agg(F.min("w").alias("w"))
        front = first.join(seen.select("root", "node"), ["root", "node"], "left_anti").select("root", "node", F.lit(d).alias("depth"), "w.key", "w.parent", "w.via")
        seen = seen.unionByName(front)
    nth = F.row_number().over(Window.partitionBy("root").orderBy("depth", "key"))
    return seen.where("depth > 0").select("root", "node", "depth", nth.alias("nth"), "parent", "via")


def within_budget(rows: DataFrame, lines: str, budget: int, *order: str) -> DataFrame:
    """Rows in order until the lines before a row reach the budget. Each row has a line or more, so only the first `budget` rows are gathered."""
    before = F.coalesce(F.sum(lines).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.orderBy(*order).limit(budget).withColumn("used_before", before).where(F.col("used_before") < budget)


def bodies(rows: DataFrame, budget: int, include: str) -> DataFrame:
    """direction, path, name, depth, shown (full or contract), text: what a trace shows within so many lines.

    rows: direction, path, name, depth, contract, source. Rows go by direction, depth, path and name until those
    shown reach the budget. A source that would pass it gives way to the contract, and so does a null or empty one; without
    a contract the name stands. Each row takes a line at least, so at most `budget` rows are gathered.
    """
    if include not in ("contracts", "full", "mixed"):
        raise ValueError(f"include is contracts, full, mixed or none, not {include!r}")
    count = lambda t: F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1
    wants = {"contracts": F.lit(False), "full": F.lit(True), "mixed": F.col("depth") == 1}[include]
    contract = F.coalesce("contract", "name")
    order = ("direction", "depth", "path", "name")
    full = F.when(wants & (F.col("source") != ""), F.col("source"))
    first = rows.select(*order, contract.alias("contract"), full.alias("source"), count(contract).alias("few"), count(full).alias("many")).orderBy(*order).limit(budget)
    held = first.agg(F.sort_array(F.collect_list(F.struct(*order, "contract", "source", "few", "many"))).alias("rows"))
    none = F.struct(F.lit(0).alias("used"), F.array().cast("array<boolean>").alias("fits"))

    def step(acc: Column, r: Column) -> Column:
        fits = r["many"].isNotNull() & (acc["used"] + r["many"] <= budget)
        more = F.struct((acc["used"] + F.when(fits, r["many"]).otherwise(r["few"])).alias("used"), F.concat(acc["fits"], F.array(fits)).alias("fits"))
        return F.when(acc["used"] >= budget, acc).otherwise(more)

    chosen = held.select("rows", F.posexplode(F.aggregate("rows", none, step)["fits"]).alias("at", "fits")).select(F.get("rows", "at").alias("r"), "fits")
    return chosen.select(*[F.col(f"r.{c}").alias(c) for c in ("direction", "path", "name", "depth")], F.when(F.col("fits"), "full").otherwise("contract").alias("shown"), F.when(F.col("fits"), F.col("r.source")).otherwise(F.col("r.contract")).alias("text"))


def confident(edges: DataFrame, least: str = "preferred") -> DataFrame:
    """Edges of at least this confidence."""
    rank = F.create_map(*[F.lit(x) for pair in RANKS.items() for x in pair])
    return edges.where(rank[F.col("confidence")] >= RANKS[least])


def ambiguities(resolved: DataFrame) -> DataFrame:
    """Calls whose name several symbols have, once by name."""
    return resolved.where("match_count > 1").groupBy("path", "caller", "callee").agg(F.min_by(F.struct("match_count", "to_path", "to_name"), "call_ord").alias("m")).select("path", "caller", "callee", "m.*")


def locator_lists(symbols: DataFrame) -> DataFrame:
    """name, n, first_path, first_name: how many functions and methods have a name, and which one is first."""
    return locators(symbols).groupBy("name").agg(F.count("*").alias("n"), F.min_by(F.struct("l_path", "l_qn"), "l_ord").alias("f")).select("name", "n", F.col("f.l_path").alias("first_path"), F.col("f.l_qn").alias("first_name"))


def locator_arrays(symbols: DataFrame) -> DataFrame:
    """name, locators: all functions and methods of a name (path, name), the first one first."""
    held = F.array_sort(F.collect_list(F.struct(F.col("l_ord").alias("ord"), F.col("l_path").alias("path"), F.col("l_qn").alias("name"))))
    return locators(symbols).groupBy("name").agg(F.transform(held, lambda r: F.struct(r["path"].alias("path"), r["name"].alias("name"))).alias("locators"))


def find_entries(files: DataFrame, wanted: Column) -> DataFrame:
    """What find_entry gives, of files with their symbols in order (symbols.python_symbols by file) and an array of the names that are wanted in each. A file's symbols lie in one row, so nothing moves."""
    defined = F.filter("symbols", lambda s: s["kind"].isin(*DEFINED))
    own = F.transform(defined, lambda s, n: F.struct(F.coalesce(s["depth"], F.lit(0)).alias("depth"), n.alias("at"), s["name"].alias("name"), s["qualified_name"].alias("qualified_name")))
    bare = lambda w: F.array_min(F.filter("own", lambda s: s["name"] == w))["qualified_name"]
    entry = lambda w: F.struct(w.alias("wanted"), F.when(F.exists("own", lambda s: s["qualified_name"] == w), w).otherwise(bare(w)).alias("qualified_name"))
    held = files.select("path", own.alias("own"), wanted.alias("names"))
    return held.select("path", F.explode_outer(F.transform("names", entry)).alias("e")).select("path", "e.*").where("qualified_name is not null")


def find_entry(symbols: DataFrame, wanted: DataFrame) -> DataFrame:
    """path, wanted, qualified_name of each (path, wanted): the symbol of that qualified name, else that of this bare name that the fewest definitions hold, of these the first in the file."""
    own = symbols.where(F.col("kind").isin(*DEFINED)).select("path", "qualified_name", "name", F.struct(F.coalesce("depth", F.lit(0)).alias("depth"), "ord").alias("ord"))
    exact = wanted.join(large(own.select("path", F.col("qualified_name").alias("wanted"), "qualified_name").dropDuplicates(["path", "wanted"])), ["path", "wanted"], "left")
    bare = own.groupBy("path", F.col("name").alias("wanted")).agg(F.min_by("qualified_name", "ord").alias("bare"))
    return exact.join(large(bare), ["path", "wanted"], "left").select("path", "wanted", F.coalesce("qualified_name", "bare").alias("qualified_name")).where("qualified_name is not null")
