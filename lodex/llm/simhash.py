"""SimHash near-duplicates by meeting in the middle.

Every different fingerprint sends out itself and all fingerprints within half the radius. Two
fingerprints within the radius share at least one of these, and those that share one are within the radius,
so no link is lost and none is wrong. Within a meeting point each member is linked to the least one only.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodex.llm.components import components
from lodex.llm.support import join_hot, small_batches, stage, text_bytes, text_slices, with_rows

SEED = 42


def fingerprint(text: bytes, words: int = 3) -> int:
    """Of a text in UTF-8: a bit is set if over half of the shingles' hashes have it."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    parts = text.lower().split()  # bytes: lower() changes A-Z alone, split() cuts at space and \x09-\x0D
    if not parts:
        return 0
    shingles = [b" ".join(parts)] if len(parts) < words else map(b" ".join, zip(*(parts[k:] for k in range(words)), strict=False))
    hashes = np.array([digest(s, SEED) for s in shingles], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for begin in range(0, len(hashes), 1 << 14):
        counts += np.unpackbits(hashes[begin : begin + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, fp, row) with the fingerprint as a signed long."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches):
            made = np.array([fingerprint(t, words) for t in text_bytes(texts)], dtype="<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array(made), rows.column("row")], names=["doc_id", "fp", "row"])

    return docs.mapInArrow(make, "doc_id long, fp long, row long")


def masks(half: int) -> list[int]:
    """All differences of at most `half` bits, as signed longs."""
    some = [sum(1 << b for b in bits) for n in range(half + 1) for bits in combinations(range(64), n)]
    return [m - (1 << 64) if m >> 63 else m for m in some]


def links(fps: DataFrame, radius: int) -> DataFrame:
    """Links (u, v) whose components are those of all pairs of different fingerprints within an even radius."""
    around = F.array(*[F.lit(m) for m in masks(radius // 2)])
    flip = lambda column: F.explode(F.transform(around, lambda m: F.col(column).bitwiseXOR(m)))
    met = fps.select("fp", flip("fp").alias("point")).groupBy("point").agg(F.min("fp").alias("u"), F.max("fp").alias("far"), F.count("*").alias("n"))
    met = stage(met.where("n > 1"), "met")  # few points hold more than one
    pairs = met.where("n = 2").select("u", F.col("far").alias("v"))
    # of three members or more, those between are among the fingerprints around the meeting point
    many = met.where("n > 2").select("u", "point").select("u", flip("point").alias("v")).join(fps.select(F.col("fp").alias("v")), "v", "left_semi").where("u <> v")
    verified = pairs.unionByName(many.select("u", "v")).distinct()
    return verified.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)


def near_duplicates(docs: DataFrame, radius: int = 2, words: int = 3, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable), kept, row of every document.

    One row of each component is kept, one with the smallest id. row_col: a number of each row that tells rows alike
    apart, given back as row; else one is made.

    radius is even: 2 gives 65 meeting points to a fingerprint, 4 gives 2,081. Null and empty texts have
    fingerprint zero and are linked like any other. Null ids count as larger than all others, so a
    component of null ids only has a null component_id. A fingerprint or component that holds a large part of
    the rows is joined by broadcast, so its rows never meet in one task. Repeated rows each give a row; an empty
    table gives none. Other columns aren't read.
    """
    if radius % 2 or not 0 <= radius <= 4:
        raise ValueError("radius is 0, 2 or 4")
    small_batches(docs.sparkSession)
    made = stage(fingerprints(with_rows(docs, row_col, doc_id=id_col, text=text_col), words), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    classes = stage(made.groupBy("fp").agg(F.min(first).alias("first"), F.count("*").alias("size")), "classes")
    roots = stage(components(links(classes.select("fp"), radius)), "roots")
    of = stage(classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    smallest = stage(of.groupBy("root").agg(F.min("first").alias("best"), F.count("*").alias("held")), "smallest")
    named = stage(join_hot(of.select("fp", "root", "size"), smallest, "root", "held", of.count()).select("fp", "size", "best"), "named")
    return join_hot(made, named, "fp", "size", made.count()).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("best.doc_id").alias("component_id"), (F.col("best.row") == F.col("row")).alias("kept"), "row")
