"""Exact deduplication by content-defined chunk recipes.

A text's recipe is the ordered list of its chunks' identifiers. Chunks end where the bytes themselves
say so, so texts that share passages share chunks. Identifiers are verified: every different chunk travels
once, and no identifier may stand for two contents; if one does, all are made anew, twice as long.
From then on equal texts are those with equal recipes, and only recipes move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodex.llm.support import small_batches, stage, text_bytes, text_slices, with_rows

#: A chunk's least and largest number of bytes; it ends with a chance of 1 in 2,048 at each byte between.
LEAST, MOST, CHANCE_BITS = 512, 8192, 11
#: Identifiers that a task remembers so as not to send the same chunk again.
REMEMBERED = 100_000
#: A group with more than one of so many rows is large.
LARGE = 1000
MIX = np.uint64(0x9E3779B97F4A7C15)


def normalised(text: bytes) -> bytes:
    """Each run of space or \\x09-\\x0D replaced by one space."""
    words = b" ".join(text.split())
    if not text or not (text[:1].isspace() or text[-1:].isspace()):
        return words
    return (b" " if text[:1].isspace() else b"") + words + (b" " if words and text[-1:].isspace() else b"")


def chunks(text: bytes) -> list[bytes]:
    """The text's chunks in order; together they are the text. An empty text has none."""
    if len(text) <= LEAST:
        return [text] if text else []
    window = np.ndarray((len(text) - 7,), dtype="<u8", buffer=text, strides=(1,))
    ends = np.flatnonzero((window * MIX) >> np.uint64(64 - CHANCE_BITS) == 0) + 8
    out, begin = [], 0
    for end in [*ends.tolist(), len(text)]:
        if end - begin < LEAST and end < len(text):
            continue
        while end - begin > MOST:
            out.append(text[begin : begin + MOST])
            begin += MOST
        if end > begin:
            out.append(text[begin:end])
            begin = end
    return out


def identifier(chunk: bytes, size: int) -> bytes:
    return hashlib.blake2b(chunk, digest_size=size).digest()


RECIPES = "doc_id long, recipe binary, text_sha256 string, row long"


def recipes(docs: DataFrame, size: int) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches):
            recipe, sha = [], []
            for text in map(normalised, text_bytes(texts)):
                recipe.append(b"".join(identifier(c, size) for c in chunks(text)))
                sha.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array(recipe, pa.binary()), pa.array(sha, pa.string()), rows.column("row")], names=["doc_id", "recipe", "text_sha256", "row"])

    return docs.mapInArrow(make, RECIPES)


def chunk_table(docs: DataFrame, size: int) -> DataFrame:
    """(identifier, chunk), each once; a chunk found in many tasks is merged before and after the shuffle."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for _, texts in text_slices(batches):
            ids, contents = [], []
            for text in text_bytes(texts):
                for chunk in chunks(normalised(text)):
                    k = identifier(chunk, size)
                    check = hash(chunk)
                    if seen.get(k) == check:  # the same content as far as this task can tell from 64 more bits
                        continue
                    if len(seen) < REMEMBERED:
                        seen[k] = check
                    ids.append(k)
                    contents.append(chunk)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(contents, pa.binary())], names=["id", "chunk"])

    return docs.mapInArrow(make, "id binary, chunk binary").distinct()


def identifiers_hold(docs: DataFrame, size: int) -> bool:
    """Whether no identifier of so many bytes stands for two different chunks."""
    return chunk_table(docs, size).groupBy("id").count().where("count > 1").isEmpty()


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", id_bytes: int = 16, row_col: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, row: one row per document, dropped ones too.

    Null texts count as empty and equal each other. The row with the smallest id of a group stays; a null id
    comes after all others, and of rows with the same id (or all null ones) one stays, the others
    go. An empty table gives no rows. Other columns aren't read. row_col: a number of each row that tells rows
    alike apart, given back as row; else one is made.
    """
    small_batches(docs.sparkSession)
    listed, size = with_rows(docs, row_col, doc_id=id_col, text=text_col), id_bytes
    while not identifiers_hold(listed.select("text"), size):
        size *= 2
        if size > 64:
            raise ValueError("identifiers of 64 bytes stand for more than one chunk")
    listed = stage(recipes(listed, size), "recipes")
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    groups = stage(listed.groupBy("recipe").agg(F.min(first).alias("first"), F.count("*").alias("group_size")).where("group_size > 1"), "groups")
    # groups of over a thousandth of all rows: at most a thousand, so their rows needn't meet in one task
    large = F.broadcast(groups.where(F.col("group_size") > F.lit(listed.count() // LARGE)))
    rest = listed.join(large.select("recipe"), "recipe", "left_anti").join(groups, "recipe", "left")
    joined = rest.select("doc_id", "row", "text_sha256", "first", "group_size").unionByName(listed.join(large, "recipe").select("doc_id", "row", "text_sha256", "first", "group_size"))
    alone = F.col("group_size").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("first.row") == F.col("row"))).alias("kept"),
        "text_sha256",
        "row",
    )
