"""Audit of how far the sources of a language are apart in the words that they use.

Each language keeps the terms of enough documents. They are dealt into chunks by hash; a chunk's terms are a sorted array, a
term's number is its place there by binary search, and the counts of each source are a dense vector by number. Numbers follow the
terms' order in UTF-8, so ties go by number. All is done in whole numbers: per billion, with one added to each count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodex.llm.support import drop, only, small_batches, stage, text_slices

#: Counts of a chunk, terms by sources, and the least terms of one.
CELLS, LEAST_TERMS = 1 << 20, 256
#: Rows that a task gathers before it merges them and, if most are left, sends them on.
GATHERED = 1 << 20
BILLION = 10**9
#: Capitals made small; all else of ASCII but small letters ends a term.
LETTERS = bytes(k + 32 if 65 <= k <= 90 else k if 97 <= k <= 122 or k > 127 else 32 for k in range(256))

COUNTED = "lang string, source string, term string, n long, docs long"
_names = [c.split()[0] for c in COUNTED.split(", ")]


def counted(rows: pa.RecordBatch, texts: pa.Array) -> pa.Table:
    """How often each term occurs in the texts of a group, and in how many of these."""
    wide = pa.types.is_large_binary(texts.type)
    kind = np.int64 if wide else np.int32
    bounds = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1]
    data = bytes(texts.buffers()[2] or b"")[bounds[0] : bounds[-1]].translate(LETTERS)
    texts = pa.Array.from_buffers(pa.large_string() if wide else pa.string(), len(texts), [None, pa.py_buffer((bounds - bounds[0]).astype(kind)), pa.py_buffer(data)])
    parts = pc.ascii_split_whitespace(texts)
    ends = np.asarray(parts.offsets, dtype=np.int64)
    words = parts.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
    which, terms = np.asarray(words.indices, dtype=np.int64), words.dictionary
    doc = np.repeat(np.arange(len(texts)), np.diff(ends))
    full = np.asarray(pc.not_equal(terms, ""))[which] if len(terms) else np.zeros(0, dtype=bool)
    pairs, n = np.unique(doc[full] * max(1, len(terms)) + which[full], return_counts=True)
    lang, source = (rows.column(c).dictionary_encode() for c in ("lang", "source"))
    group = np.asarray(lang.indices, dtype=np.int64) * len(source.dictionary) + np.asarray(source.indices)
    key, at = np.unique(group[pairs // max(1, len(terms))] * max(1, len(terms)) + pairs % max(1, len(terms)), return_inverse=True)
    group, term = key // max(1, len(terms)), key % max(1, len(terms))
    total = np.zeros(len(key), dtype=np.int64)
    np.add.at(total, at, n)
    columns = [lang.dictionary.take(pa.array(group // max(1, len(source.dictionary)))), source.dictionary.take(pa.array(group % max(1, len(source.dictionary)))), terms.take(pa.array(term)).cast(pa.string()), pa.array(total), pa.array(np.bincount(at, minlength=len(key)).astype(np.int64))]
    return pa.Table.from_arrays(columns, names=_names)


def merged(tables: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(tables).group_by(_names[:3]).aggregate([("n", "sum"), ("docs", "sum")])
    return pa.Table.from_arrays([out.column(c) for c in (*_names[:3], "n_sum", "docs_sum")], names=_names)


def count_terms(docs: DataFrame) -> DataFrame:
    """Counts of terms by language and source, as each task has them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for some, texts in text_slices(batches):
            held.append(counted(some, texts))
            rows += len(held[-1])
            if rows > GATHERED:
                held = [merged(held)]
                rows = len(held[0])
                if rows > GATHERED // 2:
                    yield from held[0].to_batches(max_chunksize=1 << 16)
                    held, rows = [], 0
        if held:
            yield from merged(held).to_batches(max_chunksize=1 << 16)

    return docs.mapInArrow(count, COUNTED)


def per_billion(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * counts / total), exact for totals under 9 * 10^15, which counts don't exceed: three digits at a time."""
    out, rest = counts // total, counts % total
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


FOUND = "lang string, source string, part string, item string, value long"


def chunk_rows(rows: pa.Table, groups: pa.Table, top: int) -> pa.Table:
    """Of a chunk: what its terms add to each pair of sources, and the first `top` terms of each source that are over the language's share."""
    groups = groups.sort_by("source")
    sources, many = groups.column("source").combine_chunks(), len(groups)
    terms = np.array(sorted(x.encode() for x in rows.column("term").to_pylist()), dtype=object)
    ids = np.searchsorted(terms, np.array([x.encode() for x in rows.column("term").to_pylist()], dtype=object)) if len(terms) else np.zeros(0, dtype=np.int64)
    held = rows.column("held").combine_chunks()
    entries, ids = held.flatten(), np.repeat(ids, np.asarray(pc.list_value_length(held)))
    of = np.asarray(pc.index_in(entries.field("source"), value_set=sources), dtype=np.int64)
    # a source has a term once, so no two counts meet and all below 2^53 stay whole
    counts = np.bincount(of * len(terms) + ids, weights=np.asarray(entries.field("n"), dtype=float), minlength=many * len(terms)).astype(np.int64).reshape(many, len(terms))
    size, kept = groups.column("words").to_numpy(), int(groups.column("kept")[0].as_py())
    p = per_billion(counts + 1, (size + kept)[:, None])
    q = per_billion(counts.sum(axis=0) + 1, np.int64(size.sum() + kept))
    out = []
    for b in range(many):
        sums = apart(p, p[b]).sum(axis=1)
        at = np.delete(np.arange(many), b)
        out.append((sources.take(pa.array(at)), "pair", pa.repeat(sources[b], len(at)), sums[at]))
        over = np.flatnonzero((counts[b] > 0) & (p[b] > q))
        value = apart(p[b][over], q[over])
        first = np.lexsort((over, -value))[:top]
        out.append((pa.repeat(sources[b], len(first)), "term", pa.array([terms[k].decode() for k in over[first].tolist()], pa.string()), value[first]))
    lang = groups.column("lang")[0]
    tables = [pa.Table.from_arrays([pa.repeat(lang, len(v)), s, pa.array([part] * len(v), pa.string()), i, pa.array(v, pa.int64())], names=[c.split()[0] for c in FOUND.split(", ")]) for s, part, i, v in out]
    return pa.concat_tables(tables)


def audit(docs: DataFrame, least_docs: int = 3, top: int = 200, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank. Part pair: the other sources of the language; part term: terms that the source uses more than the language.

    A term is a run of letters of ASCII, capitals made small, and of characters beyond. A language keeps those of least_docs of its documents.
    p is 1 + floor(10^9 * (count + 1) / (counts of all kept terms + their number)), of a source or of the language; the value is
    floor((p - q)^2 / q), q being the other source's, summed over all kept terms, or the language's, of which the first `top` by value are returned.
    Ties go to the lesser item in UTF-8. Null texts, languages and sources are empty ones. A language of one source gives no pairs, one without kept
    terms pairs of value 0. Repeated rows are documents of their own. Long texts count whole. An empty table gives no rows. Other columns aren't read.

    A language's sources are compared with each other, so the result, and each chunk, has a row for each two of them.
    """
    small_batches(docs.sparkSession)
    docs = only(docs, text=text_col, lang=lang_col, source=source_col)
    docs = docs.select("text", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")])
    # tasks send a term's counts merged; all of a term meet in one task, so both sums need one shuffle
    by_source = count_terms(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("held"))
    kept = stage(by_term.where(F.col("docs") >= least_docs).select("lang", "term", "held"), "kept")
    words = kept.select("lang", F.explode("held").alias("h")).groupBy("lang", "h.source").agg(F.sum("h.n").alias("words"))
    terms = kept.groupBy("lang").agg(F.count("*").alias("kept"))
    groups = docs.select("lang", "source").distinct().join(words, ["lang", "source"], "left").join(terms, "lang", "left").na.fill(0, ["words", "kept"])
    groups = stage(groups, "groups")
    size = F.greatest(F.lit(LEAST_TERMS), F.floor(F.lit(CELLS) / F.count("*")))
    langs = stage(groups.groupBy("lang").agg(F.greatest(F.lit(1), F.ceil(F.max("kept") / size)).cast("int").alias("chunks")), "langs")
    chunked = kept.join(langs, "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int").alias("chunk"), "term", "held")
    each = groups.join(langs, "lang").select("lang", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "source", "words", "kept")
    found = stage(chunked.groupBy("lang", "chunk").cogroup(each.groupBy("lang", "chunk")).applyInArrow(lambda a, b: chunk_rows(a, b, top), FOUND), "found")
    drop(kept, groups, langs)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    few = found.where("part = 'term'").select("*", rank).where(F.col("rank") <= top)
    return pairs.select("*", rank).unionByName(few)
