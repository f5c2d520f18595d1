"""The index of one tree and its queries."""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Iterable
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodex.config import OVERVIEW_FILES, TEXT_TIMES, VECTOR_TIMES, EngineConfig
from lodex.functions.paths import extension, under
from lodex.functions.text import file_one_liner, numbered_source, signature, source_slice
from lodex.functions.vectors import embedder, hash_embedding, literal, squared_l2, unit
from lodex.operators import fulltext, graph, patterns, retrieval, scanner, symbols, views
from lodex.operators.freshness import remove, upsert
from lodex.sources.files import mark_of, mark_sums, read, scan, tree
from lodex.sources.staging import drop, stage
from lodex.sources.store import MOST_DELTAS, Store

BASE = ("files", "symbols", "regions", "records")
DERIVED = ("postings", "lengths", "grams")


class Engine:
    """Tables: files, symbols, regions, records (with vectors); resolved calls and callers are derived anew on load."""

    def __init__(self, spark: SparkSession, config: EngineConfig, tables: dict[str, DataFrame]):
        self.spark, self.config = spark, config
        self.files, self.symbols, self.regions, self.records = (tables[n] for n in BASE)
        #: Terms of the records; tables that were never written have none, and texts are cut into words at each search.
        self.blocks, self.lengths, self.grams = (tables.get(n) for n in DERIVED)
        self.postings = None if self.blocks is None else fulltext.unpacked(self.blocks)
        self.totals = None if self.lengths is None else retrieval.totals_of(self.lengths)
        self.resolved = graph.resolve_calls(self.symbols)
        self.callers = graph.callers(self.resolved)

    @classmethod
    def build(cls, spark: SparkSession, config: EngineConfig) -> Engine:
        """Made once: each table is written into the shared folder, and what follows from it reads it there."""
        done: dict[str, DataFrame] = {}
        for name, make in _tables(scan(spark, config), config).items():
            done[name] = stage(make(done) if callable(make) else make, name)
        return cls(spark, config, done)

    @classmethod
    def load_or_build(cls, spark: SparkSession, config: EngineConfig, folder: str) -> Engine:
        """The stored tables, brought up to the tree if files changed; built and stored if there are none of this root and version."""
        tables = Store(spark, folder).load(root=config.root)
        return cls(spark, config, tables).refreshed(folder) if tables else _build_into(spark, config, folder)

    def stored(self, folder: str) -> Engine:
        """Written as a new base of the store, and read from there."""
        return _saved(self.spark, self.config, {n: getattr(self, n) for n in BASE} | _derived(), folder)

    def refreshed(self, folder: str) -> Engine:
        """Brought up to the tree as it is now; itself if nothing changed. Files whose time and size stayed aren't read.

        What was added or modified is parsed anew, what is gone goes, and of a file with new time and old content the time is noted.
        """
        old = self.files.select("path", F.col("size").alias("o_size"), F.col("mtime").alias("o_mtime"))
        now = tree(self.spark, self.config).join(old, "path", "full")
        same = (F.col("size") == F.col("o_size")) & (F.col("mtime") == F.col("o_mtime"))
        moved = stage(now.where(~F.coalesce(same, F.lit(False))), "moved")
        if moved.isEmpty():
            return self
        out = self._applied(read(self.spark, self.config, moved.where("size is not null").select("path", "size", "mtime")), moved.where("size is null").select("path"), folder)
        drop(moved)
        return out

    def applied(self, changed: Iterable[str] | DataFrame, deleted: Iterable[str] | DataFrame, folder: str) -> Engine:
        """With these paths of the tree read again and those gone, stored. What a watcher's micro-batch names; changed ones that aren't there are gone as well."""
        changed, deleted = (x.select("path") if isinstance(x, DataFrame) else self.spark.createDataFrame([(p,) for p in x], "path string") for x in (changed, deleted))
        found = stage(tree(self.spark, self.config, changed), "found")
        return self._applied(read(self.spark, self.config, found), deleted.unionByName(changed.join(found.select("path"), "path", "left_anti")), folder)

    def _applied(self, seen: DataFrame, deleted: DataFrame, folder: str) -> Engine:
        """A delta of the store: seen files, of which those with the content that they had are only noted, and deleted paths."""
        store = Store(self.spark, folder)
        seen = stage(seen, "seen")
        before = stage(self.files.select("path", "content_hash").join(seen.select("path").unionByName(deleted).distinct(), "path", "left_semi"), "before")
        touched = seen.join(before, ["path", "content_hash"], "left_semi").select("path")
        changed = seen.join(before, ["path", "content_hash"], "left_anti")
        gone = changed.select("path").unionByName(deleted.join(before, "path", "left_semi").select("path")).distinct()
        if seen.isEmpty() and gone.isEmpty():
            return self
        meta = store.meta()
        sums = [int(x) for x in meta["sums"]]
        replaced, new = (mark_sums(x, "path", "content_hash").first() for x in (before.join(gone, "path", "left_semi"), changed))
        sums = [a - int(b) + int(c) for a, b, c in zip(sums, replaced, new, strict=True)]
        # only the first table has rows of files that were only touched
        tables = _tables(changed, self.config) | {"files": seen}
        tables["symbols"], tables["regions"] = (_without(make, touched) for make in (tables["symbols"], tables["regions"]))
        tables["records"], tables["grams"] = _without(tables["records"], touched), _without(tables["grams"], touched)
        store.append(tables, gone, touched, meta["version"], fingerprint=mark_of(sums), sums=sums)
        if len(store.meta()["deltas"]) >= MOST_DELTAS:
            store.compact()
        drop(seen, before)
        return Engine(self.spark, self.config, store.load(root=self.config.root))

    def updated(self, changed: DataFrame, deleted: DataFrame) -> Engine:
        """With the changed files (rows of files) parsed anew and the deleted paths gone, no store written; what has the same content isn't parsed."""
        changed = changed.join(self.files.select("path", "content_hash"), ["path", "content_hash"], "left_anti").select(*self.files.columns)
        fresh, old = {}, dict(zip(BASE, (self.files, self.symbols, self.regions, self.records), strict=True))
        for name, make in _tables(changed, self.config).items():
            fresh[name] = make(fresh) if callable(make) else make
            if name == "symbols":  # read by several views, so parsed once
                fresh[name] = stage(fresh[name], name)
        keys = changed.select("path")
        return Engine(self.spark, self.config, {n: remove(remove(old[n], deleted), keys).unionByName(fresh[n]) if n != "files" else upsert(remove(old[n], deleted), fresh[n]) for n in BASE})

    def file_find(self, pattern: str) -> DataFrame:
        """path, public_fns, line_count, one_liner of the files that a glob matches; one with the root before it counts below the root."""
        pattern = pattern.removeprefix(f"{self.config.root.rstrip('/')}/")
        docs = self.symbols.where("kind = 'module'").select("path", F.col("doc_first").alias("docstring"))
        rows = self.files.join(views.public_counts(self.symbols), "path", "left").join(docs, "path", "left")
        return retrieval.glob_find(rows.select("path", F.coalesce("public_fns", F.lit(0)).alias("public_fns"), "line_count", file_one_liner(F.col("path"), F.col("docstring")).alias("one_liner")), pattern)

    def file_lines(self, pattern: str, include_tier1: bool = False) -> DataFrame:
        """path, line: a line for each file, with its outline below it if asked for; if none matches, one line that names the folders at the top."""
        found = self.file_find(pattern)
        line = F.concat("path", F.lit(" ["), "public_fns", F.lit("fn, "), "line_count", F.lit("L]: "), "one_liner")
        if include_tier1:
            outlines = views.outline(self.files, self.symbols).select("path", F.col("text").alias("outline"))
            found = found.join(outlines, "path", "left")
            line = F.concat(line, F.coalesce(F.concat(F.lit("\n  "), F.replace("outline", F.lit("\n"), F.lit("\n  "))), F.lit("")))
        top = self.files.where(F.col("path").contains("/")).agg(F.array_sort(F.collect_set(F.split_part("path", F.lit("/"), F.lit(1)))).alias("top"))
        none = found.limit(1).agg(F.count("*").alias("n"))
        folders = F.when(F.size("top") > 0, F.array_join("top", ", ")).otherwise("(none)")
        said = top.crossJoin(none).where("n = 0").select(F.lit(None).cast("string").alias("path"), F.concat(F.lit(f"No files matching pattern: {pattern}. Available top-level directories: "), folders, F.lit(".")).alias("line"))  # a row each
        return found.select("path", line.alias("line")).unionByName(said).orderBy("path")

    def find_code(self, pattern: str, case_sensitive: bool = False, search_in: str = "all") -> DataFrame:
        """path, start_line, end_line, kind, name, line of functions and methods, or of types.

        names: by their bare names; signatures: by types and names of parameters; descriptions: by the docstring's first
        line; types: by name or shape; all, and anything else: by the line of the outline.
        """
        if search_in == "types":
            rows = symbols.type_entries(self.symbols).select("path", "start_line", F.col("start_line").alias("end_line"), F.lit("type").alias("kind"), "name", "shape", F.concat_ws(" ", F.concat("path", F.lit(":"), "start_line"), "type_kind", "name").alias("line"))
            return retrieval.find_rows(rows, pattern, {"names": "name", "shapes": "shape"}, "all", case_sensitive).drop("shape").orderBy("path", "start_line")
        shown = F.concat(retrieval.place(F.col("path"), F.col("start_line"), F.col("end_line")), F.lit(" "), F.coalesce(F.concat("class_name", F.lit(".")), F.lit("")), views.signature_line())
        rows = self.symbols.where(F.col("kind").isin("function", "method")).select("path", "start_line", "end_line", "kind", F.col("qualified_name").alias("name"), shown.alias("line"), F.col("name").alias("bare"), signature(F.col("params"), F.col("return_type")).alias("signature"), "doc_first", F.concat(views.signature_line(), F.lit("  L"), "start_line", F.lit("-"), "end_line").alias("outline"))
        columns = {"names": "bare", "signatures": "signature", "descriptions": "doc_first", "all": "outline"}
        return retrieval.find_rows(rows, pattern, columns, search_in if search_in in columns else "all", case_sensitive).select("path", "start_line", "end_line", "kind", "name", "line").orderBy("path", "start_line")

    def keyword(self, pattern: str, max_results: int | None = None, case_sensitive: bool = False, search_in: str = "all") -> DataFrame:
        """The first 50 finds, or fewer lines, and below them a line with how many more there are."""
        found, more = retrieval.capped(self.find_code(pattern, case_sensitive, search_in), "path", "start_line", "line")
        said = more.select(retrieval.more_line(F.col("more")).alias("line")).where("line is not null")
        every = found.withColumn("below", F.lit(0)).unionByName(said.withColumn("below", F.lit(1)), allowMissingColumns=True)
        every = every.orderBy("below", "path", "start_line", "line").drop("below")
        return every if max_results is None else every.limit(max_results)

    def raw(self, pattern: str, target_dir: str = ".") -> DataFrame:
        inside = posixpath.normpath(target_dir)
        if inside.startswith(("..", "/")):
            raise ValueError(f"{target_dir} is outside the tree")
        files = self.files if inside == "." else self.files.where(under(F.col("path"), f"{inside}/"))
        return retrieval.raw_search(files, pattern) if self.grams is None else patterns.indexed_search(files, self.grams, pattern)

    def search(self, query: str, mode: str, max_results: int = 15) -> DataFrame:
        """keyword: pattern over symbols; raw: pattern over lines; semantic: vectors and full text fused."""
        if mode == "keyword":
            return self.keyword(query, max_results)
        if mode == "raw":
            return self.raw(query).orderBy("path", "line_no").limit(max_results)
        if mode != "semantic":
            raise ValueError(f"mode is keyword, semantic or raw, not {mode!r}")
        k = max_results
        vec = retrieval.nearest(self.records, squared_l2(F.col("vector"), literal(unit(encoder(self.config)(query), self.config.dimensions))), "id", 4 * k)
        words = [r[0] for r in self.spark.range(1).select(F.explode(retrieval.tokens(F.lit(query)))).collect()]
        scored = retrieval.bm25(self.records, words, "id", "text") if self.blocks is None else fulltext.top(self.blocks, self.totals, words, TEXT_TIMES * k)
        merged = retrieval.hybrid(vec, scored.orderBy(F.desc("score"), "id").limit(2 * k), k, self.config.rerank)
        hits = self.records.join(F.broadcast(merged), "id")  # 30 rows
        return retrieval.without_overlap(hits, F.col("record_type") != "region", ["path", "start_line"]).orderBy(*retrieval.fused_order()).limit(k).select("path", "start_line", "end_line", "record_type", "symbol", "score", retrieval.hit_line(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("record_type"), F.col("text")).alias("line"))

    def docstring_recall(self, k: int = 5) -> DataFrame:
        """One row: how many documented functions and methods are found by their own docstrings, at which ranks; all docstrings are asked at once."""
        asked = retrieval.docstring_queries(self.symbols).where(F.col("query") != "")
        asked = stage(embedded(asked.select(F.col("wanted").alias("query_id"), F.col("query").alias("text")), self.config.dimensions, encoder(self.config)), "queries")
        symbols_only = F.col("record_type") == "symbol"
        vec = retrieval.nearest_many(self.records.where(symbols_only).select("id", F.col("vector").alias("v")), asked.select("query_id", F.col("vector").alias("v")), VECTOR_TIMES * k)
        held = self.postings.join(self.records.where(symbols_only).select("id"), "id", "left_semi")
        fts = retrieval.bm25_many(held, self.totals, asked.select("query_id", retrieval.tokens(F.col("text")).alias("words")), TEXT_TIMES * k)
        hits = retrieval.fused_many(vec, fts, k)
        found = hits.where("id = query_id").select("query_id", "rank")
        return retrieval.recall_and_mrr(asked.select("query_id").join(found, "query_id", "left"))

    def type_shape(self, name: str, include_methods: bool = True) -> DataFrame:
        return views.type_shape(self.symbols, name, include_methods)

    def status(self) -> DataFrame:
        """One row of counts, and modes: how many files were parsed, read by line patterns, or have errors."""
        modes = views.modes(self.files, self.symbols, tuple(symbols.extractors())).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("mode", "n")))).alias("modes"))
        return views.status(self.files, self.symbols, self.regions).crossJoin(modes)  # a row each

    def outline(self, path: str | None = None, compact: bool = False) -> DataFrame:
        """Of one file, or of all by path. A file that isn't in the index but in the tree is read and parsed for it; one that is in neither gives a row that says so."""
        keep = F.col("path") == path if path else F.lit(True)
        files, rows = self.files.where(keep), self.symbols.where(keep)
        if path and files.isEmpty():
            files = stage(scan(self.spark, self.config, [path]), "file")
            rows = stage(_parsed(files, self.config), "symbols")
        made = views.outline(files, rows, compact)
        return (views.found(made, path) if path else made).orderBy("path")

    def overview(self, prefix: str | None = None, exclude: str | None = None, mode: str = "modules") -> DataFrame:
        """modules: a row per top folder; symbols: each file's outline; auto: modules for over 80 files without a prefix."""
        if mode not in ("modules", "symbols", "auto"):
            raise ValueError(f"mode is modules, symbols or auto, not {mode!r}")
        keep = under(F.col("path"), prefix, exclude)
        if mode == "symbols" or mode == "auto" and (prefix or len(self.files.where(keep).select("path").take(OVERVIEW_FILES + 1)) <= OVERVIEW_FILES):
            return views.outline(self.files.where(keep), self.symbols.where(keep)).orderBy("path")
        docs = self.symbols.where("kind = 'module'").select("path", F.col("doc_first").alias("docstring"))
        return views.overview(self.files.where(under(F.col("path"), prefix, exclude)).join(docs, "path", "left"), views.public_counts(self.symbols))

    def source(self, path: str, qualified_name: str, numbered: bool = False, fresh: bool = False) -> DataFrame:
        """The symbol's lines as they were indexed, or, if fresh, as the file has them now; of a bare name the one that the fewest definitions hold, of these the first."""
        wanted = graph.find_entry(self.symbols.where(F.col("path") == path), self.spark.createDataFrame([(path, qualified_name)], "path string, wanted string"))
        rows = self.symbols.where((F.col("path") == path) & F.col("kind").isin(*graph.DEFINED)).join(wanted, ["path", "qualified_name"], "left_semi")
        files = scan(self.spark, self.config, [path]) if fresh else self.files
        cut = numbered_source if numbered else source_slice
        return rows.join(files.select("path", F.col("text").alias("file_text")), "path").select("path", "qualified_name", "start_line", "end_line", cut(F.col("file_text"), F.col("start_line"), F.col("end_line")).alias("source"))

    def shown_source(self, path: str, qualified_name: str) -> DataFrame:
        """text: the symbol's numbered lines below a line with their range; or one that says what there is in the file."""
        found = self.source(path, qualified_name, numbered=True)
        head = F.concat("path", F.lit(f":{qualified_name} (lines "), "start_line", F.lit("-"), "end_line", F.lit("):\n"))
        own = self.symbols.where((F.col("path") == path) & F.col("kind").isin("function", "method")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "qualified_name"))), lambda r: r["qualified_name"]).alias("own"))
        none, indexed = found.limit(1).agg(F.count("*").alias("n")), self.files.where(F.col("path") == path).limit(1).agg(F.count("*").alias("known"))
        listed = F.concat(F.lit("Available functions: "), F.when(F.size("own") > 0, F.array_join("own", ", ")).otherwise("(none)"), F.lit("."))
        said = own.crossJoin(none).crossJoin(indexed).where("n = 0").select(F.concat(F.lit(f"Function {qualified_name} not found in {path}. "), F.when(F.col("known") > 0, listed).otherwise("File may not be indexed.")).alias("text"))  # a row each
        return found.select(F.concat(head, "source").alias("text")).unionByName(said)

    def source_and_trace(self, path: str, qualified_name: str, depth: int = 1) -> DataFrame:
        """part (source, callees or callers), path, name, text: the source, and below it the contracts of what it calls and what calls it."""
        own = self.source(path, qualified_name, numbered=True).select(F.lit("source").alias("part"), "path", F.col("qualified_name").alias("name"), F.col("source").alias("text"))
        near = self.trace(path, qualified_name, depth=depth, include="contracts").select(F.col("direction").alias("part"), "path", "name", "text")
        return own.unionByName(near)

    def types(self) -> DataFrame:
        """name, text: the overview's section of types."""
        return views.types_text(views.type_lookup(symbols.type_entries(self.symbols).withColumn("ord", F.lit(0)))).orderBy("name")

    def counts(self) -> DataFrame:
        """record_type, n: how many records there are to search."""
        return self.records.groupBy("record_type").agg(F.count("*").alias("n")).orderBy("record_type")

    def contracts(self) -> DataFrame:
        return views.tier2(self.symbols, self.resolved, self.callers)

    def trace(self, path: str, qualified_name: str, direction: str = "both", depth: int = 2, min_confidence: str = "preferred", include: str = "none", budget_lines: int = 300) -> DataFrame:
        """direction, path, name, depth, nth, via: callees unfiltered, callers of at least the given confidence; nth is the order in which a search finds them, via the names on the way.

        include: with the contract (contracts), the source (full), or the source of direct neighbours and contracts of
        the others (mixed), as graph.bodies gives them within so many lines.
        """
        if direction not in ("callees", "callers", "both"):
            raise ValueError(f"direction is callees, callers or both, not {direction!r}")
        node = lambda p, n: F.struct(F.col(p).alias("path"), F.col(n).alias("name"))
        inner = self.resolved.where("not is_external")
        root = self.spark.createDataFrame([((path, qualified_name),)], "node struct<path:string,name:string>")
        ways = {
            "callees": inner.select(node("path", "caller").alias("src"), node("to_path", "to_name").alias("dst"), F.col("call_ord").alias("ord")),
            "callers": graph.confident(inner, min_confidence).select(node("to_path", "to_name").alias("src"), node("path", "caller").alias("dst"), F.lit(0).alias("ord")),
        }
        found = [graph.ordered_trace(e, root.select("node", F.lit(0).alias("root")), depth).select(F.lit(w).alias("direction"), "node.path", "node.name", "depth", "nth", "via.name") for w, e in ways.items() if direction in (w, "both")]
        found = [f.toDF("direction", "path", "name", "depth", "nth", "via") for f in found]
        nodes = found[0] if len(found) == 1 else found[0].unionByName(found[1])
        if include == "none":
            return nodes
        contracts = self.contracts().select("path", F.col("qualified_name").alias("name"), F.col("text").alias("contract"))
        texts = self.files.select("path", F.col("text").alias("file_text"))
        spans = self.symbols.where(F.col("kind").isin("function", "method")).select("path", F.col("qualified_name").alias("name"), "start_line", "end_line")
        sources = spans.join(texts, "path").select("path", "name", source_slice(F.col("file_text"), F.col("start_line"), F.col("end_line")).alias("source"))
        return graph.bodies(nodes.join(contracts, ["path", "name"], "left").join(sources, ["path", "name"], "left"), budget_lines, include)

    def ambiguities(self, path: str) -> DataFrame:
        """Calls in a file whose name several symbols have: read the source before trusting a trace through them."""
        return graph.ambiguities(self.resolved.where(F.col("path") == path))


def _build_into(spark: SparkSession, config: EngineConfig, folder: str) -> Engine:
    return _saved(spark, config, _tables(scan(spark, config), config), folder)


def _saved(spark: SparkSession, config: EngineConfig, tables: dict, folder: str) -> Engine:
    """Each table is made from those already written, so files are parsed once."""
    files = stage(tables["files"], "files")
    store, sums = Store(spark, folder), list(mark_sums(files, "path", "content_hash").first())
    store.save(tables | {"files": files}, fingerprint=mark_of(sums), sums=sums, root=config.root)
    drop(files)
    return Engine(spark, config, store.load(root=config.root))


def _without(make: Callable, touched: DataFrame) -> Callable:
    return lambda done: make(done | {"files": done["files"].join(touched, "path", "left_anti")})


def _derived() -> dict[str, Callable[[dict[str, DataFrame]], DataFrame]]:
    return {"postings": lambda t: fulltext.packed(retrieval.postings(t["records"].select("path", "id", "text").repartition("path"), "id", "text", "path")), "lengths": lambda t: retrieval.lengths(t["records"], "text", "path"), "grams": lambda t: patterns.grams(t["files"])}


def _tables(files: DataFrame, config: EngineConfig) -> dict[str, DataFrame | Callable[[dict[str, DataFrame]], DataFrame]]:
    """The tables in order, those after the first by functions of those before."""
    return {"files": files, "symbols": lambda t: _parsed(t["files"], config), "regions": lambda t: symbols.regions(t["files"]), "records": lambda t: embedded(records(t["files"], t["symbols"], t["regions"]), config.dimensions, encoder(config))} | _derived()


def _parsed(files: DataFrame, config: EngineConfig) -> DataFrame:
    by_ending = symbols.extractors()
    parsed = symbols.symbols_of_files(files, by_ending)
    if not config.include_private:
        parsed = parsed.where(F.coalesce(F.col("visibility"), F.lit("public")) != "private")
    spots = symbols.line_symbols(files.where(~extension(F.col("path")).isin(*by_ending)))
    none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in parsed.schema.fields}
    known = {"path": F.col("path"), "kind": F.col("kind"), "name": F.col("name"), "qualified_name": F.col("name"), "ord": F.col("start_line"), "start_line": F.col("start_line"), "end_line": F.col("start_line"), "visibility": F.lit("public")} | {c: F.array() for c in scanner.LISTS}
    others = spots.select(*[(none | known)[f.name].cast(f.dataType).alias(f.name) for f in parsed.schema.fields])
    return parsed.unionByName(others)


def records(files: DataFrame, every: DataFrame, parts: DataFrame) -> DataFrame:
    """One embedding record for each file (with what views.preview shows of it), function, method, class, type and region."""
    lang = files.select("path", "language")
    c, none = F.col, F.lit(None).cast("string")
    line = lambda label, value: F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"{label}: "), value))
    shown = files.select("path", "language", "line_count").join(views.preview(files, every, tuple(symbols.extractors())).withColumnRenamed("text", "shown"), "path")
    of_files = shown.select(*symbols.record("file", c("path"), c("language"), none, none, F.lit(1), c("line_count"), line("Outline", c("shown"))))
    fns = every.where(c("kind").isin("function", "method")).join(lang, "path")
    shown = F.concat(c("name"), F.lit("("), views.shown_params(c("params")), F.lit(")->"), F.coalesce("return_type", F.lit("None")))
    calls = F.array_join(F.array_sort(F.transform("calls", lambda x: x["callee"])), ", ")
    of_fns = fns.select(*symbols.record("symbol", c("path"), c("language"), c("qualified_name"), none, c("start_line"), c("end_line"), line("Symbol", c("qualified_name")), line("Class", c("class_name")), line("Signature", shown), line("Docstring", F.when(F.length("doc_full") > 1000, F.concat(F.substring("doc_full", 1, 997), F.lit("..."))).otherwise(c("doc_full"))), line("Calls", calls)))
    classes = every.where("kind = 'class'").join(lang, "path")
    attrs = F.array_join(F.slice(F.transform(F.concat("class_attrs", "instance_attrs"), lambda a: a["name"]), 1, 12), ", ")
    of_classes = classes.select(*symbols.record("class", c("path"), c("language"), c("name"), none, c("start_line"), c("end_line"), line("Type", c("name")), line("Bases", F.array_join("bases", ", ")), line("Summary", c("doc_first")), line("Attributes", attrs)))
    types = symbols.type_entries(every).join(lang, "path")
    of_types = types.select(*symbols.record("type", c("path"), c("language"), F.concat(F.lit("type "), c("name")), none, c("start_line"), c("start_line"), line("Type", c("name")), line("Kind", c("type_kind")), line("Shape", c("shape"))))
    of_parts = parts.join(lang, "path").select(*symbols.record("region", c("path"), c("language"), F.concat(F.lit("region "), c("idx")), c("title"), c("start_line"), c("end_line"), line("Title", c("title")), c("parts_text") if "parts_text" in parts.columns else c("text")))
    return of_files.unionByName(of_fns).unionByName(of_classes).unionByName(of_types).unionByName(of_parts)


def encoder(config: EngineConfig) -> Callable[[str], np.ndarray]:
    """The model's function, or the hashed stand-in."""
    return config.encode or partial(hash_embedding, dims=config.dimensions)


def embedded(rows: DataFrame, dimensions: int, encode: Callable[[str], np.ndarray]) -> DataFrame:
    """With a unit vector each."""
    return rows.withColumn("vector", embedder(encode, dimensions)(F.col("text")))
