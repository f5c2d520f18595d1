"""Path, pattern, full-text and vector search, and their fusion."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lodex.config import BM25_B, BM25_K1, KEYWORD_CAP, MERGED, RERANK_MORE, RRF_K, TEXT_TIMES, VECTOR_TIMES
from lodex.functions.paths import glob_regex
from lodex.functions.text import numbered_lines, tokens


def glob_find(files: DataFrame, pattern: str, path: str = "path") -> DataFrame:
    """Indexed files that match a glob, by path."""
    return files.where(F.col(path).rlike(glob_regex(pattern))).orderBy(path)


def checked(pattern: str, case_sensitive: bool = False) -> str:
    """The pattern, if it is a valid regular expression."""
    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError(f"invalid regular expression {pattern!r}: {e}") from e
    return pattern if case_sensitive else f"(?i){pattern}"


def find_rows(rows: DataFrame, pattern: str, columns: dict[str, str], search_in: str = "all", case_sensitive: bool = False) -> DataFrame:
    """Rows with a match in the column that search_in names, or in any; an unknown name means any."""
    regex = checked(pattern, case_sensitive)
    over = [columns[search_in]] if search_in in columns else list(columns.values())
    hit: Column = F.lit(False)
    for c in over:
        hit |= F.coalesce(F.col(c), F.lit("")).rlike(regex)
    return rows.where(hit)


def capped(found: DataFrame, *order: str, cap: int = KEYWORD_CAP) -> tuple[DataFrame, DataFrame]:
    """The first rows in order, and a row with how many more there are."""
    return found.orderBy(*order).limit(cap), found.agg(F.greatest(F.count("*") - cap, F.lit(0)).cast("long").alias("more"))


#: What sees beyond its line in a whole text, or gives nothing back: a match in a line needn't be one in the text.
_FAR_SIGHTED = re.compile(r"\(\?(?:[=!>]|<[=!])|\\[AZzGRXN]|[*+?}]\+|\(\?[a-z]*-?[a-z]*[sd]")


def raw_search(files: DataFrame, pattern: str, first_only: bool = True, path: str = "path", text: str = "text") -> DataFrame:
    """path, line_no, line: the first matching line of each file, or all.

    A pattern is held against lines, so ^ and $ are a line's bounds. Files whose text has no match at all never get exploded;
    where a pattern may see more than its line, each file is.
    """
    regex = checked(pattern)
    some = files if _FAR_SIGHTED.search(pattern) else files.where(F.col(text).rlike(f"(?m){regex}"))
    lines = numbered_lines(some, path, text).where(F.col("line").rlike(regex))
    if not first_only:
        return lines
    return lines.groupBy(path).agg(F.min(F.struct("line_no", "line")).alias("m")).select(path, "m.line_no", "m.line")


def postings(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """id, len, term, tf, and more columns of the document: what bm25_of_postings reads. Stored in order of term, a search reads the row groups of its terms only."""
    words = docs.select(*more, F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("ts"))
    return words.select(*more, "id", F.size("ts").alias("len"), F.explode("ts").alias("term")).groupBy(*more, "id", "len", "term").agg(F.count("*").alias("tf"))


def by_term(held: DataFrame) -> DataFrame:
    """Postings as they are stored: ranges of terms, in order. A term of very many documents fills several files."""
    return held.repartitionByRange("term", "id").sortWithinPartitions("term")


def lengths(docs: DataFrame, text_col: str, *keys: str) -> DataFrame:
    """keys, n, len: how many documents each key has, and their words. What totals_of adds up."""
    return docs.select(*keys, F.size(tokens(F.col(text_col))).alias("len")).groupBy(*keys).agg(F.count("*").alias("n"), F.sum("len").alias("len"))


def totals_of(held: DataFrame) -> DataFrame:
    """One row: n, avg_len."""
    return held.agg(F.sum("n").alias("n"), (F.sum("len") / F.sum("n")).alias("avg_len"))


def totals(docs: DataFrame, text_col: str) -> DataFrame:
    """One row: n, avg_len."""
    return docs.select(F.size(tokens(F.col(text_col))).alias("len")).agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))


def bm25_of_postings(held: DataFrame, sums: DataFrame, query: list[str]) -> DataFrame:
    """id, score of documents with a query term, from stored postings and totals; no text is read."""
    some = held.where(F.col("term").isin(*dict.fromkeys(query)))
    df = some.groupBy("term").agg(F.count("*").alias("df"))  # a row for each query term
    room = BM25_K1 * ((1 - BM25_B) + BM25_B * F.col("len") / F.col("avg_len"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = idf * F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + room)
    return some.join(F.broadcast(df.crossJoin(sums)), "term").groupBy("id").agg(F.round(F.sum(score), 6).alias("score"))


def _best_scored(asked: pa.Table, held: pa.Table, k: int, schema: pa.Schema) -> pa.Table:
    """Each query's k best documents of a block, ties by id. asked: query_id, term, idf, avg_len; held: id, len, term, tf."""
    queries, ids, scores = [], [], []
    if len(asked) and len(held):
        terms, words = asked.column("term").unique(), asked.column("term").to_pylist()
        at = pc.index_in(held.column("term"), terms).to_numpy()
        names = pc.unique(held.column("id")).sort()
        doc = pc.index_in(held.column("id"), names).to_numpy()
        tf, room = held.column("tf").to_numpy(), BM25_K1 * ((1 - BM25_B) + BM25_B * held.column("len").to_numpy() / asked.column("avg_len")[0].as_py())
        order = np.argsort(at, kind="stable")
        doc, part = doc[order], (tf * (BM25_K1 + 1) / (tf + room))[order]
        ends = np.searchsorted(at[order], np.arange(len(terms) + 1))
        number = {t: n for n, t in enumerate(terms.to_pylist())}
        by_query: dict = {}
        for name, term, idf in zip(asked.column("query_id").to_pylist(), words, asked.column("idf").to_pylist(), strict=True):
            by_query.setdefault(name, []).append((number[term], idf))
        for name, wanted in by_query.items():
            score = np.zeros(len(names))
            for n, idf in sorted(wanted):
                here = slice(ends[n], ends[n + 1])
                score[doc[here]] += idf * part[here]  # a document has a term once
            some = np.flatnonzero(score)
            first = some[np.argsort(-np.round(score[some], 6), kind="stable")[:k]]
            queries += [name] * len(first)
            ids += names.take(pa.array(first)).to_pylist()
            scores += np.round(score[first], 6).tolist()
    return pa.table([pa.array(c, f.type) for c, f in zip((queries, ids, scores), schema, strict=True)], schema=schema)


#: Documents and queries of a block.
DOCUMENTS, QUERIES = 4096, 256


def bm25_many(held: DataFrame, sums: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank (from 1), id, score: the k best of each query (query_id, words). Queries are sent to all tasks only if Spark finds them small.

    Documents and queries are dealt into blocks by hash; each two blocks meet in one task, which scores the documents and gives
    a query's best k, so no row is made for a query and a document that share a word.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct("words")).alias("term"))
    some = held.join(queries.select(F.explode("words").alias("term")).distinct(), "term", "left_semi")
    df = some.groupBy("term").agg(F.count("*").alias("df"))  # a row for each query term
    blocks = lambda n, size: F.greatest(F.ceil(n / size), F.lit(1)).cast("int")
    sizes = F.broadcast(sums.crossJoin(queries.agg(F.count("*").alias("asked"))).select("n", "avg_len", blocks(F.col("n"), DOCUMENTS).alias("bs"), blocks(F.col("asked"), QUERIES).alias("qs")))  # one row
    deal = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    left = asked.join(df, "term").crossJoin(sizes).select("query_id", "term", idf.alias("idf"), "avg_len", deal("query_id", F.col("qs")).alias("q"), every("bs").alias("b"))
    right = some.crossJoin(sizes).select("id", "len", "term", "tf", deal("id", F.col("bs")).alias("b"), every("qs").alias("q"))
    found = queries.select("query_id").schema.add(held.schema["id"]).add("score", "double")
    arrow = to_arrow_schema(found)
    best = left.groupBy("b", "q").cogroup(right.groupBy("b", "q")).applyInArrow(lambda x, y: _best_scored(x, y, k, arrow), found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def bm25(docs: DataFrame, query: list[str], id_col: str, text_col: str) -> DataFrame:
    """id, score of documents with a query term. Only query terms are counted; lengths are summed in the same pass."""
    terms = [F.lit(t) for t in dict.fromkeys(query)]
    words = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("ts"))
    many = lambda t: F.size(F.filter("ts", lambda x: x == t))
    held = words.select("id", F.size("ts").alias("len"), *[many(t).alias(f"tf{k}") for k, t in enumerate(terms)]).repartition("id")  # small rows, so texts are cut into words once
    n_terms = range(len(terms))
    stats = held.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"), *[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in n_terms])
    idf = lambda k: F.log(1 + (F.col("n") - F.col(f"df{k}") + 0.5) / (F.col(f"df{k}") + 0.5))
    room = BM25_K1 * ((1 - BM25_B) + BM25_B * F.col("len") / F.col("avg_len"))
    score = sum((idf(k) * F.col(f"tf{k}") * (BM25_K1 + 1) / (F.col(f"tf{k}") + room) for k in n_terms), F.lit(0.0))
    # one row of statistics; a filter that needs it stays above, so both sides read the same exchange
    scored = held.crossJoin(F.broadcast(stats)).select("id", score.alias("score")).where("score > 0")
    return scored.select("id", F.round("score", 6).alias("score"))


def nearest(vectors: DataFrame, distance: Column, id_col: str, k: int) -> DataFrame:
    """id, distance: the k nearest, kept per task before they meet."""
    return vectors.select(F.col(id_col).alias("id"), F.round(distance, 6).alias("distance")).orderBy("distance", "id").limit(k)


FOUND = "query_id string, id string, distance double"


def _best_of_block(queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """Each query's k nearest of a block, ties by id."""
    wide = lambda c: np.asarray(c.combine_chunks().flatten(), dtype=np.float64).reshape(len(c), -1)
    out: list[tuple[list, list, list]] = []
    if len(queries) and len(rows):
        rows = rows.sort_by("id")
        ids, x = rows.column("id").to_pylist(), wide(rows.column("v"))
        for name, q in zip(queries.column("query_id").to_pylist(), wide(queries.column("v")), strict=True):
            d = np.round(((x - q) ** 2).sum(axis=1), 6)
            first = np.argsort(d, kind="stable")[:k]
            out.append(([name] * len(first), [ids[j] for j in first.tolist()], d[first].tolist()))
    columns = [[x for part in out for x in part[c]] for c in range(3)]
    return pa.table({"query_id": pa.array(columns[0], pa.string()), "id": pa.array(columns[1], pa.string()), "distance": pa.array(columns[2], pa.float64())})


def nearest_many(vectors: DataFrame, queries: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """query_id, rank (from 1), id, distance: the k nearest of vectors (id, v) for each of queries (query_id, v) by squared distance, ties by id.

    Both are dealt into blocks by hash; each two blocks meet in one task, which gives a query's best k, so however many there are, a task
    holds two blocks, and a vector is moved once for each block of queries.
    """
    parts = lambda df: max(1, -(-df.count() // block))
    of_rows, of_queries = parts(vectors), parts(queries)
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    right = vectors.select(F.col("id").cast("string").alias("id"), F.col("v").cast("array<double>").alias("v")).withColumns({"b": deal("id", of_rows)}).withColumn("q", every(of_queries))
    left = queries.select(F.col("query_id").cast("string").alias("query_id"), F.col("v").cast("array<double>").alias("v")).withColumns({"q": deal("query_id", of_queries)}).withColumn("b", every(of_rows))
    best = left.groupBy("b", "q").cogroup(right.groupBy("b", "q")).applyInArrow(lambda x, y: _best_of_block(x, y, k), FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def fused_many(vec: DataFrame, fts: DataFrame, k: int, room: int = RRF_K) -> DataFrame:
    """query_id, rank (from 1), id, score: the lists of each query (query_id, rank from 1, id) fused by the sum of 1/(rank + 60); ties by vector, then text rank."""
    both = vec.select("query_id", "id", F.col("rank").alias("vec_rank")).join(fts.select("query_id", "id", F.col("rank").alias("fts_rank")), ["query_id", "id"], "full")
    part = lambda c: F.coalesce(1.0 / (F.col(c) - 1 + F.lit(float(room))), F.lit(0.0))
    scored = both.withColumn("score", F.round(part("vec_rank") + part("fts_rank"), 9))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("vec_rank").asc_nulls_last(), F.col("fts_rank").asc_nulls_last(), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def ranked(found: DataFrame, *order) -> DataFrame:
    """rank from 0 of an already limited list."""
    return found.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)


def rrf(vector_ranks: DataFrame, text_ranks: DataFrame, k: int = RRF_K) -> DataFrame:
    """id, score, vec_rank, fts_rank: sum of 1/(rank + k) over both lists; ties by vector, then text rank."""
    both = vector_ranks.select("id", F.col("rank").alias("vec_rank")).join(text_ranks.select("id", F.col("rank").alias("fts_rank")), "id", "full")
    part = lambda c: F.coalesce(1.0 / (F.col(c) + F.lit(float(k))), F.lit(0.0))
    return both.select("id", F.round(part("vec_rank") + part("fts_rank"), 9).alias("score"), "vec_rank", "fts_rank")


def fused_order() -> list[Column]:
    return [F.desc("score"), F.asc_nulls_last("vec_rank"), F.asc_nulls_last("fts_rank"), F.asc("id")]


def without_overlap(hits: DataFrame, structured: Column, place: list[str]) -> DataFrame:
    """Drop unstructured hits that begin where a structured one does."""
    return hits.where(structured).unionByName(hits.where(~structured).join(hits.where(structured).select(*place).distinct(), place, "left_anti"))


def hybrid(vector_hits: DataFrame, text_hits: DataFrame, k: int, rerank: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Fuse the nearest 4k and the best 2k texts, keep 30, rerank k + 5 if there is a reranker; a failing one changes nothing."""
    vec = ranked(vector_hits.orderBy("distance", "id").limit(VECTOR_TIMES * k), "distance", "id")
    fts = ranked(text_hits.orderBy(F.desc("score"), "id").limit(TEXT_TIMES * k), F.desc("score"), "id")
    merged = rrf(vec, fts).orderBy(*fused_order()).limit(MERGED)
    if rerank is not None:
        try:
            made = rerank(merged.limit(k + RERANK_MORE))
            return merged.sparkSession.createDataFrame(made.collect(), made.schema)  # k + 5 rows; a model fails when it runs
        except Exception:  # noqa: BLE001 - a model that can't be loaded or run leaves the fused order
            pass
    return merged


def hit_line(path: Column, start: Column, end: Column, kind: Column, text: Column) -> Column:
    """path[:start[-end]] kind signature"""
    place = F.when(start.isNull(), F.lit("")).when(end > start, F.concat(F.lit(":"), start, F.lit("-"), end)).otherwise(F.concat(F.lit(":"), start))
    sign = F.regexp_replace(F.regexp_extract(text, r"(?m)^Signature: (.*)$", 1), r"  L\d+(?:-\d+)?$", "")
    return F.rtrim(F.concat_ws(" ", F.concat(path, place), kind, sign))


def recall_and_mrr(ranks: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """ranks: rank from 1 of a query's first acceptable hit, null without one. Recall at each k, and the mean reciprocal rank."""
    share = [F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6).alias(f"recall_at_{k}") for k in ks]
    return ranks.agg(F.count("*").alias("n"), *share, F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


def hit_id(line: Column) -> Column:
    """path::symbol of a hit's line; null for lines that aren't hits: blank ones, notes in brackets and those on what was left out."""
    hit = F.trim(line)
    signature = F.regexp_replace(F.split_part(F.regexp_extract(hit, r"^\S+\s+\S+\s+(.*)$", 1), F.lit("("), F.lit(1)), "^async ", "")
    name = F.element_at(F.split(F.trim(signature), " "), -1)
    place = F.split_part(F.split_part(hit, F.lit(" "), F.lit(1)), F.lit(":"), F.lit(1))
    return F.when((hit != "") & ~hit.rlike(r"^(?:\[|\.\.\.)"), F.concat(place, F.lit("::"), name))


def docstring_queries(symbols: DataFrame, least: int = 20, most: int = 500) -> DataFrame:
    """query, wanted (path::symbol): documented functions and methods, each to be found by its own docstring."""
    doc = F.trim(F.col("doc_full"))
    return symbols.where(F.col("kind").isin("function", "method") & (F.length(doc) >= least)).select(F.substring(doc, 1, most).alias("query"), F.concat("path", F.lit("::"), "qualified_name").alias("wanted"))


def first_hits(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, rank: the first hit (query_id, rank, id) that holds, in any case, one of a query's accepted texts (query_id, accepted); null if none does."""
    accepted = F.exists("accepted", lambda a: F.lower("id").contains(F.lower(a)))
    return queries.select("query_id", "accepted").join(hits.select("query_id", "rank", "id"), "query_id", "left").groupBy("query_id").agg(F.min(F.when(accepted, F.col("rank"))).alias("rank"))


def more_line(more: Column) -> Column:
    """What stands below a capped list; null if nothing was left out."""
    return F.when(more > 0, F.concat(F.lit("...and "), more, F.lit(" more. Narrow your search or use a more specific pattern.")))


def place(path: Column, start: Column, end: Column) -> Column:
    """path[:start[-end]]"""
    return F.concat(path, F.when(start.isNull(), "").when(end > start, F.concat(F.lit(":"), start, F.lit("-"), end)).otherwise(F.concat(F.lit(":"), start)))
