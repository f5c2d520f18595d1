"""Each query applies operators of the library to a whole test table; its SQL says the same for DuckDB.

documents are files (path source/lang/doc_id.txt), pages are files with URLs, embeddings are vectors, events
are file events; modules of code are made of parts in plans/code.py.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodex.functions import paths, text, vectors
from lodex.operators import freshness, fulltext, graph, patterns, retrieval, symbols
from lodex.plans import code, syntax  # noqa: F401 - register their queries
from lodex.plans.registry import ORACLE_SQL, QUERIES, query, table  # noqa: F401
from lodex.sources.files import env_pairs, fingerprint
from lodex.sources.staging import stage
from lodex.streaming import watch


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("path", F.concat_ws("/", "source", "lang", F.concat("doc_id", F.lit(".txt"))))


FILES = "WITH files AS (SELECT *, source || '/' || lang || '/' || doc_id || '.txt' AS path FROM documents)"


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))


@query("SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@query(r"SELECT coalesce(nullif(lower(regexp_extract(url, '(\.[^./]+)$', 1)), ''), '') AS ext, count(*) AS n FROM pages GROUP BY 1")
def ext_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(paths.extension(F.col("url")).alias("ext")).agg(F.count("*").alias("n"))


@query(f"{FILES} SELECT lang AS segment, CASE WHEN path LIKE '%.txt' THEN 'text' ELSE 'unknown' END AS language, count(*) AS n FROM files GROUP BY 1, 2")
def language_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_files(spark, sf_dir).groupBy(F.col("lang").alias("segment"), paths.language(F.col("path")).alias("language")).agg(F.count("*").alias("n"))


@query(f"{FILES} SELECT path, doc_id FROM files WHERE lang <> 'fr' AND path NOT LIKE 'src3/%' AND path NOT LIKE 'src4/%' AND (source <> 'src5' OR lang = 'en')")
def path_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = paths.wanted(F.col("path"), exclude=("fr",), ignore_lines=("/src5/**", "!/src5/en/")) & paths.under(F.col("path"), without="src3/, src4/")
    return doc_files(spark, sf_dir).where(keep).select("path", "doc_id")


@query(rf"{FILES} SELECT path FROM files WHERE regexp_matches(path, '^src1[^/]*/[^/]+/[^/]*5\.txt$')")
def glob_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.glob_find(doc_files(spark, sf_dir).select("path"), "src1*/*/*5.txt")


@query(f"{FILES} SELECT path FROM files WHERE lang = 'de' AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def glob_semi_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    indexed = table(spark, sf_dir, "labels").where("quality = 1")
    return retrieval.glob_find(doc_files(spark, sf_dir).join(indexed, "doc_id", "left_semi").select("path"), "*/de/**")


LINES = f"{FILES}, lines AS (SELECT path, doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no, unnest(string_split(text, chr(10))) AS line FROM files WHERE text <> '')"


@query(f"{LINES} SELECT path, min(line_no)::BIGINT AS line_no, arg_min(line, line_no) AS line FROM lines WHERE regexp_matches(line, '(?i)license|copyright') GROUP BY path")
def raw_grep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.raw_search(doc_files(spark, sf_dir), "license|copyright").select("path", F.col("line_no").cast("long").alias("line_no"), "line")


@query(f"{LINES} SELECT path, line_no::BIGINT AS line_no, line FROM lines WHERE regexp_matches(line, '(?i)license|copyright') ORDER BY path, line_no LIMIT 50")
def raw_grep_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.raw_search(doc_files(spark, sf_dir), "license|copyright", first_only=False)
    return retrieval.capped(found, "path", "line_no")[0].select("path", F.col("line_no").cast("long").alias("line_no"), "line")


@query(f"{LINES} SELECT path, line_no::BIGINT AS line_no, line FROM lines WHERE regexp_matches(line, '(?i)(all rights|permission) (is|reserved)|licen[cs]e')")
def raw_grep_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by pattern, of the files that hold the three-byte runs that it needs."""
    files = doc_files(spark, sf_dir)
    index = stage(patterns.grams(files), "grams")
    found = patterns.indexed_search(files, index, "(all rights|permission) (is|reserved)|licen[cs]e", first_only=False)
    return found.select("path", F.col("line_no").cast("long").alias("line_no"), "line")


PART_COLUMNS = {"names": "p_name", "signatures": "p_brand", "types": "p_type"}


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(?i)^a|e[dl]') ORDER BY p_name, p_partkey LIMIT 50")
def keyword_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.capped(retrieval.find_rows(table(spark, sf_dir, "part"), "^a|e[dl]", PART_COLUMNS, "names"), "p_name", "p_partkey")[0].select("p_partkey", "p_name")


@query("SELECT greatest(count(*) - 50, 0)::BIGINT AS more FROM part WHERE regexp_matches(p_name, '(?i)#1|e') OR regexp_matches(p_brand, '(?i)#1|e') OR regexp_matches(p_type, '(?i)#1|e')")
def keyword_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.capped(retrieval.find_rows(table(spark, sf_dir, "part"), "#1|e", PART_COLUMNS), "p_partkey")[1]


@query(f"{LINES}, s AS (SELECT doc_id, count(*) AS lines, count(*) FILTER (trim(line) <> '') AS full_lines, sum(length(line))::BIGINT AS chars FROM lines GROUP BY 1) SELECT * FROM s")
def line_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = text.numbered_lines(table(spark, sf_dir, "documents"), "doc_id")
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(F.trim("line") != "").alias("full_lines"), F.sum(F.length("line")).alias("chars"))


TOKENS = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


@query(f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY 1 ORDER BY df DESC, term LIMIT 100")
def token_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "term").limit(100)


QUERY_WORDS = ("license", "version", "the", "moron")
BM25_SQL = f"""tk AS (SELECT doc_id AS id, {TOKENS} AS ts FROM documents),
    st AS (SELECT count(*) AS n, avg(len(ts)) AS a FROM tk),
    qt AS (SELECT unnest({list(QUERY_WORDS)}) AS term),
    tf AS (SELECT id, len(ts) AS l, term, len(list_filter(ts, lambda x: x = term)) AS f FROM tk, qt),
    df AS (SELECT term, count(*) AS d FROM tf WHERE f > 0 GROUP BY 1),
    fts AS (SELECT id, round(sum(ln(1 + (n - d + 0.5) / (d + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / a))), 6) AS score FROM tf JOIN df USING (term), st WHERE f > 0 GROUP BY 1)"""


@query(f"WITH {BM25_SQL} SELECT id, score FROM fts ORDER BY score DESC, id LIMIT 30")
def fts_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25(table(spark, sf_dir, "documents"), list(QUERY_WORDS), "doc_id", "text").orderBy(F.desc("score"), "id").limit(30)


@query(f"WITH {BM25_SQL} SELECT id, score FROM fts ORDER BY score DESC, id LIMIT 30")
def fts_bm25_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search over postings, which an engine's store holds in order of term."""
    docs = table(spark, sf_dir, "documents")
    held = retrieval.by_term(retrieval.postings(docs, "doc_id", "text"))
    return retrieval.bm25_of_postings(held, retrieval.totals(docs, "text"), list(QUERY_WORDS)).orderBy(F.desc("score"), "id").limit(30)


#: Documents of a block: those of a range of so many ids; and words of which one task makes postings, so its memory doesn't grow with the table.
BLOCK, WORDS = 16, 1_000_000


def _blocks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Packed postings and totals, written once, as a store holds them."""
    docs = table(spark, sf_dir, "documents")
    sums = stage(retrieval.totals(docs, "text"), "totals")
    n, mean = sums.first()
    tasks = -(-int(n * (mean or 0)) // WORDS) or 1
    dealt = docs.select("doc_id", "text", F.expr(f"doc_id div {BLOCK}").alias("block")).repartition(tasks, "block")  # texts move once, postings never
    return stage(fulltext.packed(retrieval.postings(dealt, "doc_id", "text", "block"), "block"), "blocks"), sums


@query(f"WITH {BM25_SQL} SELECT id, score FROM fts ORDER BY score DESC, id LIMIT 30")
def fts_bm25_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search, which opens only the blocks of postings that can hold one of the 30 best."""
    return fulltext.top(*_blocks(spark, sf_dir), QUERY_WORDS, 30, "block")


@query(f"""WITH {BM25_SQL},
    bt AS (SELECT id // {BLOCK} AS block, term, max(f) AS f, min(l) AS l, count(*) AS p FROM tf WHERE f > 0 GROUP BY 1, 2),
    bb AS (SELECT block, round(sum(ln(1 + (n - d + 0.5) / (d + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / a))), 6) AS bound, sum(p) AS p FROM bt JOIN df USING (term), st GROUP BY 1),
    best AS (SELECT score FROM fts WHERE id // {BLOCK} IN (SELECT block FROM bb ORDER BY bound DESC, block LIMIT 30) ORDER BY score DESC LIMIT 30),
    th AS (SELECT min(score) AS s FROM best)
    SELECT count(*) AS blocks, sum(p)::BIGINT AS postings, count(*) FILTER (bound + 0.0000015 >= s) AS opened_blocks, (sum(p) FILTER (bound + 0.0000015 >= s))::BIGINT AS opened_postings FROM bb, th""")
def fts_blocks_opened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many blocks and postings the query's terms have, and how many the search opens."""
    return fulltext.opened(*_blocks(spark, sf_dir), QUERY_WORDS, 30, "block")


EVAL_SQL = f"""r AS (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'b' || item_id, text FROM benchmark),
    tk AS (SELECT id, {TOKENS} AS ts FROM r), st AS (SELECT count(*) AS n, avg(len(ts)) AS a FROM tk),
    qt AS (SELECT DISTINCT item_id, unnest(list_slice({TOKENS}, 1, 10)) AS term FROM benchmark),
    po AS (SELECT id, l, term, count(*) AS f FROM (SELECT id, len(ts) AS l, unnest(ts) AS term FROM tk) WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2, 3),
    df AS (SELECT term, count(*) AS d FROM po GROUP BY 1),
    sc AS (SELECT item_id, id, round(sum(ln(1 + (n - d + 0.5) / (d + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / a))), 6) AS score FROM qt JOIN po USING (term) JOIN df USING (term), st GROUP BY 1, 2),
    rk AS (SELECT item_id, id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS rank FROM sc),
    fh AS (SELECT b.item_id, min(rk.rank) FILTER (rk.rank <= 10 AND rk.id = 'b' || b.item_id) AS rank FROM benchmark b LEFT JOIN rk ON rk.item_id = b.item_id GROUP BY 1)"""


def _benchmark_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank: where each passage is found by its first ten words, among all documents and passages; null beyond the tenth."""
    passages = table(spark, sf_dir, "benchmark")
    records = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text").unionByName(passages.select(F.concat(F.lit("b"), "item_id").alias("id"), "text"))
    asked = passages.select(F.col("item_id").alias("query_id"), F.slice(text.tokens(F.col("text")), 1, 10).alias("words"))
    hits = retrieval.bm25_many(retrieval.postings(records, "id", "text"), retrieval.totals(records, "text"), asked, 10)
    wanted = passages.select(F.col("item_id").alias("query_id"), F.concat(F.lit("="), F.lit("b"), "item_id", F.lit("=")).alias("a")).select("query_id", F.array("a").alias("accepted"))
    return retrieval.first_hits(wanted, hits.withColumn("id", F.concat(F.lit("="), "id", F.lit("="))))


@query(f"WITH {EVAL_SQL} SELECT item_id AS query_id, rank::BIGINT AS rank FROM fh")
def benchmark_first_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _benchmark_ranks(spark, sf_dir).select("query_id", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {EVAL_SQL} SELECT count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_at_1, round(avg(CASE WHEN rank <= 3 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_at_3, round(avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_at_5, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr FROM fh")
def benchmark_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.recall_and_mrr(_benchmark_ranks(spark, sf_dir))


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return table(spark, sf_dir, "embeddings").where("vec_id = 7").first()["embedding"]


DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda t: t[1]::DOUBLE * t[2]::DOUBLE))"
L2 = "list_sum(list_transform(list_zip({a}, {b}), lambda t: (t[1]::DOUBLE - t[2]::DOUBLE) * (t[1]::DOUBLE - t[2]::DOUBLE)))"
Q = "(SELECT embedding FROM embeddings WHERE vec_id = 7)"
VEC_SQL = f"vec AS (SELECT vec_id AS id, round({L2.format(a='embedding', b=Q)}, 6) AS distance FROM embeddings)"


@query(f"WITH {VEC_SQL} SELECT id, distance FROM vec ORDER BY distance, id LIMIT 60")
def vector_knn_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.nearest(table(spark, sf_dir, "embeddings"), vectors.squared_l2(F.col("embedding"), vectors.literal(query_vector(spark, sf_dir))), "vec_id", 60)


@query(f"""WITH d AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round({L2.format(a='v.embedding', b='q.embedding')}, 6) AS distance FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id::VARCHAR) AS rank FROM d)
    SELECT query_id::VARCHAR AS query_id, rank::INTEGER AS rank, id::VARCHAR AS id, distance FROM r WHERE rank <= 10""")
def vector_knn_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of all vectors for each fiftieth one, block by block."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return retrieval.nearest_many(rows, rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), "v"), 10, block=512)


@query(f"SELECT vec_id AS id, round(1 - {DOT.format(a='embedding', b=Q)} / (sqrt({DOT.format(a='embedding', b='embedding')}) * sqrt({DOT.format(a=Q, b=Q)})), 6) AS distance FROM embeddings ORDER BY distance, id LIMIT 60")
def vector_knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.nearest(table(spark, sf_dir, "embeddings"), 1 - vectors.cosine(F.col("embedding"), vectors.literal(query_vector(spark, sf_dir))), "vec_id", 60)


@query(f"SELECT vec_id AS id, round({L2.format(a='embedding', b=Q)}, 6) AS distance FROM embeddings WHERE label = 1 ORDER BY distance, id LIMIT 20")
def vector_knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.nearest(table(spark, sf_dir, "embeddings").where("label = 1"), vectors.squared_l2(F.col("embedding"), vectors.literal(query_vector(spark, sf_dir))), "vec_id", 20)


@query(f"WITH c AS (SELECT vec_id, list_transform(embedding[1:32], lambda x: x::DOUBLE) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt({DOT.format(a='v', b='v')}) AS m FROM c) SELECT vec_id, len(v)::INTEGER AS dims, round(v[1] / CASE WHEN m = 0 THEN 1 ELSE m END, 6) AS first, round(v[32] / CASE WHEN m = 0 THEN 1 ELSE m END, 6) AS last FROM n")
def vector_truncate_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = table(spark, sf_dir, "embeddings").select("vec_id", vectors.truncated(F.col("embedding"), 32).alias("v"))
    return cut.select("vec_id", F.size("v").alias("dims"), F.round(F.col("v")[0], 6).alias("first"), F.round(F.col("v")[31], 6).alias("last"))


RRF_SQL = f"""{VEC_SQL}, {BM25_SQL},
    vr AS (SELECT id, row_number() OVER (ORDER BY distance, id) - 1 AS r FROM vec ORDER BY distance, id LIMIT 60),
    fr AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS r FROM fts ORDER BY score DESC, id LIMIT 30),
    fused AS (SELECT coalesce(vr.id, fr.id) AS id, round(coalesce(1.0::DOUBLE / (vr.r + 60), 0) + coalesce(1.0::DOUBLE / (fr.r + 60), 0), 9) AS score, vr.r AS vec_rank, fr.r AS fts_rank FROM vr FULL JOIN fr ON vr.id = fr.id),
    merged AS (SELECT * FROM fused ORDER BY score DESC, vec_rank NULLS LAST, fts_rank NULLS LAST, id LIMIT 30)"""


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.hybrid(vector_knn_l2(spark, sf_dir), fts_bm25_topk(spark, sf_dir), 15)


@query(f"WITH {RRF_SQL} SELECT id, score, vec_rank::BIGINT AS vec_rank, fts_rank::BIGINT AS fts_rank FROM merged")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).select("id", "score", F.col("vec_rank").cast("long").alias("vec_rank"), F.col("fts_rank").cast("long").alias("fts_rank"))


@query("WITH h AS (SELECT conv_id, turn, role FROM conversations) SELECT conv_id, turn, role FROM h WHERE role = 'user' OR (conv_id, turn) NOT IN (SELECT (conv_id, turn + 1) FROM h WHERE role = 'user')")
def overlap_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.when(F.col("role") == "user", F.col("turn") + 1).otherwise(F.col("turn")).alias("start_line"))
    return retrieval.without_overlap(hits, F.col("role") == "user", ["conv_id", "start_line"]).select("conv_id", "turn", "role")


@query(f"WITH {RRF_SQL}, h AS (SELECT m.*, d.source, d.lang FROM merged m LEFT JOIN documents d ON m.id = d.doc_id), k AS (SELECT * FROM h WHERE lang = 'en' OR source IS NULL OR source NOT IN (SELECT source FROM h WHERE lang = 'en' AND source IS NOT NULL)) SELECT id, score, source, lang FROM k ORDER BY score DESC, vec_rank NULLS LAST, fts_rank NULLS LAST, id LIMIT 15")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "lang")
    hits = F.broadcast(_merged(spark, sf_dir)).join(docs, "id", "left")
    kept = retrieval.without_overlap(hits, F.coalesce(F.col("lang") == "en", F.lit(False)), ["source"])
    return kept.orderBy(*retrieval.fused_order()).limit(15).select("id", "score", "source", "lang")


@query(r"""WITH t AS (SELECT page_id::VARCHAR AS path, string_split(regexp_replace(html, '<(\w+)', chr(10) || 'class \1' || chr(10), 'g'), chr(10)) AS ls FROM pages),
    l AS (SELECT path, unnest(range(1, len(ls) + 1)) AS n, trim(unnest(ls)) AS line FROM t)
    SELECT path, 'class' AS kind, regexp_extract(line, '^(?:export\s+)?class\s+([A-Za-z_][A-Za-z0-9_]*)', 1) AS name, min(n)::BIGINT AS start_line FROM l WHERE regexp_matches(line, '^(?:export\s+)?class\s+[A-Za-z_]') GROUP BY 1, 2, 3""")
def regex_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.regexp_replace("html", r"<(\w+)", "\nclass $1\n").alias("text"))
    return symbols.line_symbols(files).where("kind = 'class'").select("path", "kind", "name", F.col("start_line").cast("long").alias("start_line"))


@query(rf"{LINES} SELECT doc_id, count(*) FILTER (trim(line) = '' OR regexp_matches(trim(line), '^#{{1,6}}\s+\S+|^\[.+\]$|^\{{?$|^(?:def|class)\s+\w+|^(?:interface|type)\s+\w+')) AS boundaries FROM lines GROUP BY 1")
def region_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = text.numbered_lines(table(spark, sf_dir, "documents"), "doc_id")
    return lines.groupBy("doc_id").agg(F.count_if(symbols.is_boundary(F.col("line"))).alias("boundaries"))


@query()
def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.regions(doc_files(spark, sf_dir).withColumn("language", F.lit("text")))


BOUNDARY_SQL = r"regexp_matches(trim(line), '^#{{1,6}}\s+\S+|^\[.+\]$|^\{{?$|^(?:def|class)\s+\w+|^(?:interface|type)\s+\w+')".replace("{{", "{").replace("}}", "}")


@query(f"""{LINES}, n AS (SELECT path, line_no, trim(line) = '' AS blank, {BOUNDARY_SQL} OR coalesce(lag(trim(line) = '') OVER w, true) AS new FROM lines WINDOW w AS (PARTITION BY path ORDER BY line_no)),
    g AS (SELECT path, line_no, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line_no) AS k FROM n WHERE NOT blank)
    SELECT path, (row_number() OVER (PARTITION BY path ORDER BY k) - 1)::INTEGER AS idx, min(line_no)::INTEGER AS start_line, max(line_no)::INTEGER AS end_line FROM g GROUP BY path, k""")
def regions_uncapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions between boundaries of all files, with no limit of lines, characters, number or file size."""
    return symbols.regions(doc_files(spark, sf_dir).withColumn("language", F.lit("text")), None, None, None, None, None).select("path", "idx", "start_line", "end_line")


@query("WITH l AS (SELECT 'K' || p_partkey AS k, CASE p_size % 4 WHEN 0 THEN '# ' || p_name WHEN 1 THEN '' ELSE ' K' || p_partkey || ' = ' || p_name || '=x ' END AS line FROM part) SELECT k AS key, substr(trim(line), strpos(trim(line), '=') + 2) AS val FROM l WHERE line LIKE '%=%' AND NOT starts_with(trim(line), '#')")
def env_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("p_size") % 4
    line = F.when(kind == 0, F.concat(F.lit("# "), "p_name")).when(kind == 1, "").otherwise(F.concat(F.lit(" K"), "p_partkey", F.lit(" = "), "p_name", F.lit("=x ")))
    return env_pairs(table(spark, sf_dir, "part").select(line.alias("value")))


@query(f"{FILES} SELECT path FROM files WHERE doc_id % 7 = 3 AND source <> 'src3'")
def depth_limited_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names up to three folders deep, but for those below a folder to keep: every seventh file is asked for by name."""
    files = doc_files(spark, sf_dir).withColumn("path", F.concat_ws("/", "source", "lang", F.when(F.col("doc_id") % 7 == 3, "wanted.txt").otherwise("other.txt"), F.concat("doc_id", F.lit(".txt"))))
    place = F.substring_index("path", "/", 3)
    hit = files.where(paths.named_within(place, ["wanted.txt"], 3, ["src3"]))
    return hit.select(F.concat_ws("/", "source", "lang", F.concat("doc_id", F.lit(".txt"))).alias("path"))


@query("SELECT p_partkey, contains(chr(10) || p_type || chr(10) || p_name, p_name) AS held, contains(p_type || p_name, trim(p_brand)) AS other FROM part")
def managed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_ = F.concat(F.lit("\n"), "p_type", F.lit("\n"), "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", text.holds_block(text_, F.concat(F.lit("\n "), "p_name", F.lit(" \n"))).alias("held"), text.holds_block(F.concat("p_type", "p_name"), F.col("p_brand")).alias("other"))


@query(f"""{FILES} SELECT path || '::__file__' AS id, 'file' AS record_type, 'File: ' || path || chr(10) || 'Language: ' || lang || chr(10) || 'Size: ' || n_chars AS text FROM files
    UNION ALL SELECT url || '::__page__', 'page', 'File: ' || url || chr(10) || 'Language: html' FROM pages
    UNION ALL SELECT conv_id || '::' || turn, 'turn', 'File: ' || conv_id || chr(10) || 'Language: ' || role || chr(10) || 'Title: ' || left(text, 40) FROM conversations WHERE text IS NOT NULL""")
def record_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    none, c = F.lit(None).cast("string"), F.col
    files = doc_files(spark, sf_dir).select(*symbols.record("file", c("path"), c("lang"), none, none, F.lit(1), F.lit(1), F.concat(F.lit("Size: "), "n_chars")))
    pages = table(spark, sf_dir, "pages").select(*symbols.record("page", c("url"), F.lit("html"), none, none, F.lit(1), F.lit(1)))
    turns = table(spark, sf_dir, "conversations").where("text is not null").select(*symbols.record("turn", c("conv_id").cast("string"), c("role"), c("turn").cast("string"), none, c("turn"), c("turn"), F.concat(F.lit("Title: "), F.left("text", F.lit(40)))))
    return files.unionByName(pages).unionByName(turns).select("id", "record_type", "text")



@query(r"WITH n AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '__' || p_name || '__' WHEN 1 THEN '__' || p_name WHEN 2 THEN '_' || p_name ELSE p_name END AS name, p_size % 4 AS k FROM part) SELECT p_partkey, CASE k WHEN 1 THEN 'private' WHEN 2 THEN 'protected' ELSE 'public' END AS visibility FROM n")
def visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 4
    name = F.when(k == 0, F.concat(F.lit("__"), "p_name", F.lit("__"))).when(k == 1, F.concat(F.lit("__"), "p_name")).when(k == 2, F.concat(F.lit("_"), "p_name")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", text.visibility(name).alias("visibility"))


EDGES_SQL = "edges AS (SELECT DISTINCT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION SELECT DISTINCT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT DISTINCT 'c' || c_custkey, 'n' || c_nationkey FROM customer)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda letter, c: F.concat(F.lit(letter), c)
    nation, supplier, customer = (table(spark, sf_dir, t) for t in ("nation", "supplier", "customer"))
    return nation.select(name("n", "n_nationkey").alias("src"), name("r", "n_regionkey").alias("dst")).unionByName(supplier.select(name("s", "s_suppkey").alias("src"), name("n", "s_nationkey").alias("dst"))).unionByName(customer.select(name("c", "c_custkey").alias("src"), name("n", "c_nationkey").alias("dst"))).distinct()


TRACE = "WITH RECURSIVE {edges}, t(node, depth) AS (SELECT '{root}', 0 UNION SELECT {to}, depth + 1 FROM t JOIN edges ON {at} = node WHERE depth < {depth}) SELECT node, min(depth)::INTEGER AS depth FROM t WHERE node <> '{root}' GROUP BY 1"


@query(TRACE.format(edges=EDGES_SQL, root="s1", to="dst", at="src", depth=3))
def trace_callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.trace(_edges(spark, sf_dir), spark.createDataFrame([("s1",)], "node string"), 9)


@query(TRACE.format(edges=EDGES_SQL, root="r1", to="src", at="dst", depth=2))
def trace_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = _edges(spark, sf_dir).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.trace(back, spark.createDataFrame([("r1",)], "node string"), 2)


@query("WITH s AS (SELECT c_custkey, c_nationkey, coalesce(sum(c_nationkey + 1) OVER (ORDER BY c_nationkey, c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used_before FROM customer WHERE c_mktsegment = 'BUILDING') SELECT c_custkey, used_before FROM s WHERE used_before < 300")
def trace_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").withColumn("lines", F.col("c_nationkey") + 1)
    return graph.within_budget(rows, "lines", 300, "c_nationkey", "c_custkey").select("c_custkey", F.col("used_before").cast("long").alias("used_before"))






@query("SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 97) || '...' ELSE text END AS one_liner FROM documents")
def one_liner_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.one_liner(F.col("text")).alias("one_liner"))



RANKS_SQL = "ranks AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey % 6 + 1 END AS rank FROM orders)"


def _ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey") % 6 + 1).alias("rank"))


@query(f"WITH {RANKS_SQL} SELECT count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_at_1, round(avg(CASE WHEN rank <= 3 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_at_3, round(avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_at_5, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr FROM ranks")
def recall_and_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.recall_and_mrr(_ranks(spark, sf_dir))


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("f"), "o_orderkey").alias("path"), F.lit(1).alias("mtime"), F.col("o_orderstatus").alias("content_hash"))
    k = F.col("o_orderkey")
    new = o.where(k % 10 != 0).select("o_orderkey", "path", F.when(k % 10 == 3, 2).otherwise(1).alias("mtime"), F.when(k % 10 == 1, "X").otherwise(F.col("content_hash")).alias("content_hash"))
    return o.where(k % 10 != 5), new


SNAP_SQL = "o AS (SELECT 'f' || o_orderkey AS path, 1 AS mtime, o_orderstatus AS h FROM orders WHERE o_orderkey % 10 <> 5), n AS (SELECT 'f' || o_orderkey AS path, CASE WHEN o_orderkey % 10 = 3 THEN 2 ELSE 1 END AS mtime, CASE WHEN o_orderkey % 10 = 1 THEN 'X' ELSE o_orderstatus END AS h FROM orders WHERE o_orderkey % 10 <> 0)"


@query(f"WITH {SNAP_SQL} SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' WHEN o.h <> n.h THEN 'modified' WHEN o.mtime <> n.mtime THEN 'touched' ELSE 'unchanged' END AS status FROM o FULL JOIN n ON o.path = n.path")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freshness.snapshot_diff(*_snapshots(spark, sf_dir))


QUARTERS = ", ".join(f"sum(('0x' || substr(h, {1 + 15 * k}, 15))::BIGINT)" for k in range(4))


@query(f"WITH h AS (SELECT sha256(doc_id || chr(31) || n_chars) AS h FROM documents) SELECT sha256(concat_ws(',', count(*), {QUARTERS})) AS fingerprint FROM h")
def snapshot_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("n_chars").cast("string").alias("n_chars")), "doc_id", "n_chars")


@query(f"WITH {SNAP_SQL} SELECT path, mtime::INTEGER AS mtime, h AS content_hash FROM o WHERE path NOT IN (SELECT path FROM n) UNION ALL SELECT path, mtime::INTEGER, h FROM n")
def upsert_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _snapshots(spark, sf_dir)
    return freshness.upsert(old.select("path", "mtime", "content_hash"), new.select("path", "mtime", "content_hash"))


@query(f"WITH {SNAP_SQL} SELECT path, h AS content_hash FROM o WHERE path NOT IN (SELECT path FROM n WHERE h = 'X')")
def tombstone_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _snapshots(spark, sf_dir)
    return freshness.remove(old, new.where("content_hash = 'X'")).select("path", "content_hash")


@query(f"WITH {SNAP_SQL} SELECT o.path, CASE WHEN o.h = n.h THEN 'OK' ELSE 'FAIL' END AS result FROM o LEFT JOIN n ON o.path = n.path")
def verify_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freshness.verify(*_snapshots(spark, sf_dir))


def file_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_events(table(spark, sf_dir, "events"))


def _as_events(events: DataFrame) -> DataFrame:
    return events.select(F.concat(F.lit("u"), "user_id").alias("path"), F.when(F.col("event_type") == "error", "delete").otherwise("change").alias("op"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))


@query("""WITH g AS (SELECT user_id, ts, event_id, event_type, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
    SELECT 'u' || user_id AS path, CASE WHEN arg_max(event_type, struct_pack(a := ts, b := event_id)) = 'error' THEN 'delete' ELSE 'change' END AS op, count(*) AS events, (epoch_us(min(ts)) // 1000)::BIGINT AS begin_ms FROM s GROUP BY user_id, k""")
def debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    bursts = watch.debounced(file_events(spark, sf_dir), "30 minutes")
    return bursts.select("path", "op", "events", F.unix_millis("begin").alias("begin_ms"))


@query("WITH p AS (SELECT event_type AS due, user_id FROM events GROUP BY 1, 2) SELECT due, 'u' || user_id AS path, floor((row_number() OVER (PARTITION BY due ORDER BY 'u' || user_id) - 1) / 64)::BIGINT AS tick FROM p")
def flush_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    pending = table(spark, sf_dir, "events").select(F.col("event_type").alias("due"), F.concat(F.lit("u"), "user_id").alias("path")).distinct()
    return watch.flush_batches(pending).select("due", "path", F.col("tick").cast("long").alias("tick"))


@query(ORACLE_SQL["debounce_sessions"])
def stream_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming twin of debounce_sessions. A last event far ahead, of no path, moves the watermark past all bursts when the input ends."""
    import uuid

    where = f"{_streams(spark)}/{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events")
    events.limit(1).withColumn("ts", F.lit("2999-01-01").cast("timestamp").cast(events.schema["ts"].dataType)).withColumn("user_id", F.lit(None).cast(events.schema["user_id"].dataType)).write.parquet(f"{where}/end")
    read = lambda place: spark.readStream.schema(events.schema).parquet(place)
    raw = read(f"{sf_dir}/events.parquet*").unionByName(read(f"{where}/end"))
    out = watch.debounced(_as_events(raw), "30 minutes", late="10 minutes")  # its own burst stays open
    done = out.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).outputMode("append").start()
    done.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{where}/out").select("path", "op", "events", F.unix_millis("begin").alias("begin_ms"))


@query("""WITH e AS (SELECT 'u' || user_id AS path, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'change' END AS op, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events),
    d AS (SELECT *, CASE WHEN op = 'delete' THEN (ms // 60000 + 1) * 60000 ELSE ms + 1800000 END AS due, lead(ms) OVER (PARTITION BY path ORDER BY n) AS later FROM e),
    f AS (SELECT *, n - coalesce(lag(n) OVER (PARTITION BY path ORDER BY n), 0) AS events FROM d WHERE later IS NULL OR later >= due),
    t AS (SELECT path, op, due, events, ceil(due / 60000)::BIGINT AS tick FROM f)
    SELECT path, op, due::BIGINT AS due_ms, events, tick, (CASE WHEN op = 'delete' THEN 0 ELSE 1 + (row_number() OVER (PARTITION BY tick, op = 'delete' ORDER BY due, path) - 1) // 64 END)::INTEGER AS nth FROM t""")
def stream_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream through keyed timers: changes wait for half an hour of quiet, deletes for the next minute; then the batches of each minute."""
    import uuid

    from lodex.streaming import timers

    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    where = f"{_streams(spark)}/{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events")
    events.limit(1).withColumn("ts", F.lit("2199-01-01").cast("timestamp").cast(events.schema["ts"].dataType)).withColumn("user_id", F.lit(None).cast(events.schema["user_id"].dataType)).write.parquet(f"{where}/end")
    read = lambda place: spark.readStream.schema(events.schema).parquet(place)
    raw = _as_events(read(f"{sf_dir}/events.parquet*").unionByName(read(f"{where}/end"))).withColumn("path", F.coalesce("path", F.lit("")))  # the end's own operation stays pending
    spark.conf.set(key, timers.PROVIDER)
    try:
        out = timers.pending_flushes(raw, 1_800_000, 60_000, late="10 minutes")
        done = out.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).outputMode("append").start()
        done.awaitTermination()
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
    flushed = spark.read.schema(out.schema).parquet(f"{where}/out")
    return timers.flush_order(flushed, tick_ms=60_000).select("path", "op", F.unix_millis("due").alias("due_ms"), "events", "tick", "nth")


def _streams(spark: SparkSession) -> str:
    """A folder that driver and executors share; one on this machine only if all run here."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return f"{named.rstrip('/')}/streams"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    import tempfile

    return tempfile.mkdtemp(prefix="lodex-streams-")


@query("SELECT split_part(p_name, ' ', 1) AS word, count(*) AS n, count(DISTINCT p_brand) AS brands FROM part GROUP BY 1")
def name_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("word")).agg(F.count("*").alias("n"), F.count_distinct("p_brand").alias("brands"))


@query(f"{LINES} SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS source FROM lines WHERE line_no BETWEEN 2 AND 4 GROUP BY 1")
def source_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where(F.size(text.lines_of(F.col("text"))) >= 2)
    return rows.select("doc_id", text.source_slice(F.col("text"), F.lit(2), F.lit(4)).alias("source"))


@query("SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + CASE WHEN text = '' THEN 0 ELSE 1 END AS line_count FROM documents")
def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.line_count(F.col("text")).cast("long").alias("line_count"))


@query("SELECT url, regexp_extract(url, '[^/]*$') || '-' || left(sha256(url), 16) AS cache_key FROM pages")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("url", paths.cache_key(F.col("url")).alias("cache_key"))



@query("WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS b FROM orders) SELECT o_custkey, max(CASE WHEN a = 1 THEN o_orderkey END) AS first_def, max(CASE WHEN b = 1 THEN o_orderkey END) AS last_def FROM o GROUP BY 1")
def first_and_last_definition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_def"), F.max("o_orderkey").alias("last_def"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid_search(spark, sf_dir)
