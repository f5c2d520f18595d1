"""Queries over files that are written out of the table part in several languages, and over a store of them.

How many lines and errors a file has varies with the part's size; braces stand in strings and comments, and bodies on one line.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodex.operators import graph, symbols
from lodex.plans.registry import dealt, query, table
from lodex.sources.staging import shared_folder, stage
from lodex.sources.store import Store

#: File name ending, and the file: k is the part's key, e as many lines as its size leaves by four.
SOURCES = {
    "js": ('class Part{k} { run(a, b = "}") { return `}{`; } /* } */\n  go(x) {\n', "    call(x);\n", '    return x; } }\nconst f{k} = (y) => { g("{"); };\n'),
    "go": ('package m\nfunc Do{k}(a, b int) string { if a > 0 { return "}" }; return "{" }\ntype T{k} struct {\n', "  f int // }\n", "}\nfunc (t T{k}) Get(n int) int {\n  return t.q.Run(n) }\n"),
    "rs": ("pub struct P{k} { a: u8 }\nimpl P{k} { fn new<'a>(x: &'a str) -> Self { let c = '}'; make(c) }\n", "  // }\n", '  fn two(&self) { let s = r#"}"#; self.one(); } }\n'),
    "java": ('public class C{k} { String s = "}"; @Override public int size(int a, int b) { return this.x.get(a); }\n', "  // {\n", "  void none() { char c = '}'; } }\n"),
}
#: What each file defines: ending, kind, name, first and last line, parameters, calls.
DEFINED = (
    ("js", "class", "'Part' || k", "1", "3 + e", "", "''"),
    ("js", "method", "'Part' || k || '.run'", "1", "1", "a,b", "''"),
    ("js", "method", "'Part' || k || '.go'", "2", "3 + e", "x", "CASE WHEN e > 0 THEN 'call:' || e ELSE '' END"),
    ("js", "function", "'f' || k", "4 + e", "4 + e", "y", "'g:1'"),
    ("go", "function", "'Do' || k", "2", "2", "a,b", "''"),
    ("go", "class", "'T' || k", "3", "4 + e", "", "''"),
    ("go", "function", "'Get'", "5 + e", "6 + e", "n", "'t.q.Run:1'"),
    ("rs", "class", "'P' || k", "1", "1", "", "''"),
    ("rs", "method", "'P' || k || '.new'", "2", "2", "x", "'make:1'"),
    ("rs", "method", "'P' || k || '.two'", "3 + e", "3 + e", "self", "'self.one:1'"),
    ("java", "class", "'C' || k", "1", "2 + e", "", "''"),
    ("java", "method", "'C' || k || '.size'", "1", "1", "a,b", "'this.x.get:1'"),
    ("java", "method", "'C' || k || '.none'", "2 + e", "2 + e", "", "''"),
)
PARTS = "WITH p AS (SELECT p_partkey AS k, p_size % 4 AS e, p_size AS s FROM part)"
SYNTAX_SQL = f"{PARTS} " + " UNION ALL ".join(f"SELECT 'm' || k || '.{end}' AS path, '{kind}' AS kind, {name} AS qualified_name, ({a})::INTEGER AS start_line, ({b})::INTEGER AS end_line, '{params}' AS params, {calls} AS calls FROM p" for end, kind, name, a, b, params, calls in DEFINED)


def _filled(template: str) -> Column:
    return F.replace(F.lit(template), F.lit("{k}"), F.col("p_partkey").cast("string"))


@query(SYNTAX_SQL)
def syntax_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions, parameters and calls in JavaScript, Go, Rust and Java."""
    files = [F.struct(F.concat(F.lit("m"), "p_partkey", F.lit(f".{end}")).alias("path"), F.concat(_filled(head), F.repeat(F.lit(line), F.col("p_size") % 4), _filled(tail)).alias("text")) for end, (head, line, tail) in SOURCES.items()]
    rows = symbols.symbols_of_files(dealt(table(spark, sf_dir, "part"), "p_partkey").select(F.explode(F.array(*files)).alias("f")).select("f.*"), symbols.extractors(), ("path", "kind", "qualified_name", "start_line", "end_line", "params", "calls"))
    shown = F.array_join(F.transform("calls", lambda c: F.concat(c["callee"], F.lit(":"), c["n"])), ",")
    return rows.select("path", "kind", "qualified_name", "start_line", "end_line", F.array_join("params.name", ",").alias("params"), shown.alias("calls"))


NESTED = """def outer_{k}(a):
    def inner(b):
        class Deep:
            def act(self): return b
        return Deep
    return inner
class Box:
    class In:
        def act(self): pass
    def act(self):
        if self:
            def inner(): pass
        return inner
"""


def _nested(spark: SparkSession, sf_dir: str, columns: str = "", kinds: str = "", by_file: bool = False) -> DataFrame:
    more = F.when(F.col("p_size") % 2 == 1, "def inner(): pass\n").otherwise("")
    return symbols.python_symbols(dealt(table(spark, sf_dir, "part"), "p_partkey").select(F.concat(F.lit("m"), "p_partkey", F.lit(".py")).alias("path"), F.concat(_filled(NESTED), more).alias("text")), columns.split(), kinds.split(), by_file)


@query(f"""{PARTS} SELECT 'm' || k || '.py' AS path, t.* FROM (SELECT k, unnest([
    {{'kind': 'inner_function', 'name': 'outer_' || k || '.inner', 'depth': 1, 'parent': 'outer_' || k, 'start_line': 2, 'end_line': 5}},
    {{'kind': 'inner_class', 'name': 'outer_' || k || '.inner.Deep', 'depth': 2, 'parent': 'outer_' || k || '.inner', 'start_line': 3, 'end_line': 4}},
    {{'kind': 'inner_method', 'name': 'outer_' || k || '.inner.Deep.act', 'depth': 3, 'parent': 'outer_' || k || '.inner.Deep', 'start_line': 4, 'end_line': 4}},
    {{'kind': 'inner_class', 'name': 'Box.In', 'depth': 1, 'parent': 'Box', 'start_line': 8, 'end_line': 9}},
    {{'kind': 'inner_method', 'name': 'Box.In.act', 'depth': 2, 'parent': 'Box.In', 'start_line': 9, 'end_line': 9}},
    {{'kind': 'inner_function', 'name': 'Box.act.inner', 'depth': 2, 'parent': 'Box.act', 'start_line': 12, 'end_line': 12}}]) AS t FROM p)""")
def nested_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is defined within functions and classes."""
    return _nested(spark, sf_dir, "path kind qualified_name depth parent start_line end_line").where(F.col("kind").startswith("inner")).select("path", "kind", F.col("qualified_name").alias("name"), "depth", "parent", "start_line", "end_line")


@query(f"""{PARTS} SELECT 'm' || k || '.py' AS path, w AS wanted, CASE w WHEN 'inner' THEN CASE WHEN s % 2 = 1 THEN 'inner' ELSE 'outer_' || k || '.inner' END WHEN 'act' THEN 'Box.act' WHEN 'Deep' THEN 'outer_' || k || '.inner.Deep' ELSE w END AS qualified_name
    FROM p, (VALUES ('inner'), ('act'), ('Deep'), ('Box.In.act')) v(w)""")
def shallowest_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several symbols of a name the one that the fewest definitions hold."""
    files = stage(_nested(spark, sf_dir, "kind name qualified_name depth", " ".join(("module", *graph.DEFINED)), by_file=True), "entries")
    names = F.array(*[F.lit(x) for x in ("inner", "act", "Deep", "Box.In.act", "missing")])
    return graph.find_entries(files, F.when(F.exists("symbols", lambda s: s["kind"] == "module"), names))


@query(f"""{PARTS}, n AS (SELECT k, 1 + s % 8 AS n, CASE WHEN s % 8 >= 5 THEN 1 ELSE 0 END AS torn FROM p)
    SELECT 'm' || k || '.py' AS path, 'error' AS kind, array_to_string([('syntax error at L' || (2 * i) || ':7: ''x = 1 1''') FOR i IN range(1, least(n, 5) + 1)], '; ') || CASE WHEN n + torn > 5 THEN ' (+' || (n + torn - 5) || ' more)' ELSE '' END AS said, NULL AS start_line, NULL AS end_line FROM n
    UNION ALL SELECT 'm' || k || '.py', 'function', 'sound' || i, (2 * i - 1)::INTEGER, (2 * i - 1)::INTEGER FROM (SELECT k, unnest(range(1, n + 1)) AS i FROM n)
    UNION ALL SELECT 'm' || k || '.py', 'class', 'Half', (2 * n + 1)::INTEGER, (2 * n + 5)::INTEGER FROM n
    UNION ALL SELECT 'm' || k || '.py', 'method', 'Half.whole', (2 * n + 2)::INTEGER, (2 * n + 2)::INTEGER FROM n
    UNION ALL SELECT 'm' || k || '.py', 'method', 'Half.torn', (2 * n + 3)::INTEGER, (2 * n + 4)::INTEGER FROM n
    UNION ALL SELECT 'm' || k || '.py', 'method', 'Half.last', (2 * n + 5)::INTEGER, (2 * n + 5)::INTEGER FROM n""")
def recovered_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules with one to eight errors and, from the sixth on, one in a method: all that is sound is found; five errors are told."""
    lines = F.array_join(F.transform(F.sequence(F.lit(1), 1 + F.col("p_size") % 8), lambda i: F.concat(F.lit("def sound"), i, F.lit("(): pass\nx = 1 1\n"))), "")
    body = F.concat(lines, F.lit("class Half:\n    def whole(self): pass\n    def torn(self):\n        return ("), F.when(F.col("p_size") % 8 >= 5, "1 1").otherwise("1"), F.lit(")\n    def last(self): pass\n"))
    rows = symbols.python_symbols(dealt(table(spark, sf_dir, "part"), "p_partkey").select(F.concat(F.lit("m"), "p_partkey", F.lit(".py")).alias("path"), body.alias("text")), ("path", "kind", "error", "qualified_name", "start_line", "end_line"), ("error", "function", "class", "method"))
    return rows.where("kind in ('error', 'function', 'class', 'method')").select("path", "kind", F.coalesce("error", "qualified_name").alias("said"), "start_line", "end_line")


@query("""WITH s AS (SELECT p_partkey AS k, p_size AS mark, CASE WHEN p_partkey % 5 BETWEEN 1 AND 3 THEN p_partkey % 5 ELSE 0 END AS changed, CASE WHEN p_partkey % 7 BETWEEN 1 AND 3 THEN p_partkey % 7 ELSE 0 END AS gone FROM part)
    SELECT 'p' || k AS path, (CASE WHEN changed > 0 THEN mark + 1000 * changed ELSE mark END)::INTEGER AS mark, 't' || (CASE WHEN changed > 0 THEN mark + 1000 * changed ELSE mark END) AS term FROM s WHERE gone = 0 OR changed > gone""")
def store_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files of a store: a base and three deltas, of which the first two are compacted before the third comes."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("p"), "p_partkey").alias("path"), F.col("p_size").cast("int").alias("mark"))
    tables = lambda rows: {"files": rows.select("path", "mark"), "records": rows.select("path", F.lit("file").alias("record_type"), F.concat(F.lit("t"), "mark").alias("term"))}
    store = Store(spark, f"{shared_folder(spark).rstrip('/')}/lodex-store-{uuid.uuid4().hex}", 4)
    store.save(tables(part))
    for step in (1, 2, 3):
        gone = part.where(F.col("p_partkey") % 7 == step)
        changed = part.where((F.col("p_partkey") % 5 == step) & (F.col("p_partkey") % 7 != step)).withColumn("mark", F.col("mark") + 1000 * step)
        store.append(tables(changed), changed.select("path").unionByName(gone.select("path")))
        if step == 2:
            store.compact()
    held = store.load()
    return held["files"].join(held["records"], "path").select("path", "mark", "term")


@query(f"""WITH RECURSIVE n AS (SELECT count(*) AS n FROM part), e AS (SELECT p_partkey AS src, p_partkey * 3 % n + 1 AS dst, 0 AS ord FROM part, n UNION ALL SELECT p_partkey, p_partkey * 7 % n + 1, 1 FROM part, n UNION ALL SELECT p_partkey, p_partkey // 2 + 1, 2 FROM part),
    w AS (SELECT p_partkey AS root, p_partkey AS node, 0 AS depth, []::BIGINT[] AS key, []::BIGINT[] AS via FROM part WHERE p_size = 1
        UNION ALL SELECT w.root, e.dst, w.depth + 1, w.key || [e.ord::BIGINT, e.dst::BIGINT], w.via || [e.src::BIGINT] FROM w JOIN e ON e.src = w.node WHERE w.depth < 3),
    f AS (SELECT root, node, min(struct_pack(depth, key, via)) AS b FROM w GROUP BY 1, 2)
    SELECT root::BIGINT AS root, node::BIGINT AS node, b.depth::INTEGER AS depth, (row_number() OVER (PARTITION BY root ORDER BY b.depth, b.key))::INTEGER AS nth, array_to_string(b.via, '>') AS via FROM f WHERE b.depth > 0""")
def trace_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which a breadth-first search from each part of the least size finds others, and the way to each."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("k"), "p_size")
    n = F.lit(part.count())
    edges = part.select(F.col("k").alias("src"), F.posexplode(F.array(F.col("k") * 3 % n + 1, F.col("k") * 7 % n + 1, F.floor(F.col("k") / 2) + 1)).alias("ord", "dst"))
    return graph.ordered_trace(edges, part.where("p_size = 1").select(F.col("k").alias("root"), F.col("k").alias("node")), 3).select("root", "node", "depth", "nth", F.array_join("via", ">").alias("via"))
