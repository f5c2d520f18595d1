"""Approximate nearest neighbours by cross-polytope hashing.

A pseudo-rotation (three times: random signs, then a Hadamard transform) turns a unit vector, and the nearest
signed axis is its bucket; with several rotations to a table, these axes together. Each of several tables has rotations
of its own; a query looks into the buckets of its few nearest axes. Buckets and the queries that look into them are cut
into blocks of bounded size, so a bucket that holds a third of all vectors is searched by many tasks; each block returns
a query's best few by exact cosine.

How many tables, rotations and buckets to look into follows from the data: a few queries, SAMPLE_QUERIES at most, are
searched exactly in one pass, and of all settings that find enough of their neighbours the one with the least work is taken.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodex.llm.support import only, stage

#: Vectors and queries of a block.
BLOCK, QUERY_BLOCK = 4096, 16_384
#: Queries and vectors that a setting is chosen by, and the share of the queries' neighbours that it has to find there.
SAMPLE_QUERIES, SAMPLE_VECTORS, ENOUGH = 100, 4096, 0.96
#: Time of moving a row to another task in that of comparing two vectors, roughly.
MOVE = 100
#: Numbers of buckets of whose sizes a table is broadcast.
MOST_SENT = 200_000


class Setting(NamedTuple):
    """Tables, rotations of each, and buckets that a query looks into in each."""

    tables: int
    rotations: int
    probes: int


SETTINGS = [Setting(t, r, p) for r in (1, 2, 3) for t in (4, 8, 12) for p in (1, 2, 4, 8, 12, 16, 24, 32, 48, 64, 96, 128, 256, 512)]


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, orthonormal; the width is a power of two."""
    x, n, h = x.copy(), x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


@lru_cache(maxsize=256)
def signs(table: int, rotation: int, width: int) -> np.ndarray:
    return np.random.default_rng([table, width, rotation]).choice([-1.0, 1.0], size=(3, width))


def rotated(vectors: np.ndarray, table: int, rotation: int) -> np.ndarray:
    """Distances' opposite to all signed axes: axis k is number k, its negative k + width."""
    width = 1 << max(0, int(vectors.shape[1] - 1).bit_length())
    x = np.zeros((len(vectors), width))
    x[:, : vectors.shape[1]] = vectors
    for s in signs(table, rotation, width):
        x = hadamard(x * s)
    return np.concatenate([x, -x], axis=1)


def buckets(unit: np.ndarray, table: int, rotations: int, probes: int) -> np.ndarray:
    """Of each vector its nearest buckets, nearest first; as many as there are, if fewer. A bucket's number has the axes as its digits."""
    codes, near = np.zeros((len(unit), 1), dtype=np.int64), np.zeros((len(unit), 1))
    # with several rotations, the nearest few buckets have near axes only
    axes_of_each = probes if rotations == 1 else min(probes, 4 * math.ceil(probes ** (1 / rotations)))
    for rotation in range(rotations):
        close = rotated(unit, table, rotation)
        most = min(axes_of_each, close.shape[1])
        axes = close.argmax(axis=1)[:, None] if most == 1 else np.argsort(-close, axis=1, kind="stable")[:, :most]
        codes = (codes[:, :, None] * close.shape[1] + axes[:, None, :]).reshape(len(unit), -1)
        near = (near[:, :, None] + np.take_along_axis(close, axes, axis=1)[:, None, :]).reshape(len(unit), -1)
        if codes.shape[1] > probes:  # the best of all need only the best of those before
            first = np.argpartition(-near, probes, axis=1)[:, :probes]
            first = np.take_along_axis(first, np.argsort(-np.take_along_axis(near, first, axis=1), axis=1, kind="stable"), axis=1)
            codes, near = np.take_along_axis(codes, first, axis=1), np.take_along_axis(near, first, axis=1)
    return codes


def scaled(x: np.ndarray) -> np.ndarray:
    """Each vector times a power of two that brings its largest component near one: directions stay, and nothing over- or underflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None])


def units(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v: those with an id, a direction, and finite components only; components in their own precision."""
    v = F.col("v")
    kind = vectors.schema[vector_col].dataType.simpleString()
    held = only(vectors, vec_id=id_col, v=vector_col).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast(kind if kind == "array<float>" else "array<double>").alias("v"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return held.where(F.col("vec_id").isNotNull() & v.isNotNull() & F.coalesce(fine, F.lit(False)))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


HASHED = "dim int, tab int, bucket long, vec_id long, nr long, v "


def hashed(vectors: DataFrame, setting: Setting, probes: int) -> DataFrame:
    """A row for each table and each of so many buckets, nearest first. nr: the row's number, given where it is read, so that it lands in the same block however often it is moved."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = TaskContext.get().partitionId() << 40
        for batch in batches:
            batch = batch.append_column("nr", pa.array(np.arange(seen, seen + len(batch))))
            seen += len(batch)
            sizes = np.asarray(pa.compute.list_value_length(batch.column("v")))
            for dim in np.unique(sizes):
                rows = batch.filter(pa.array(sizes == dim))
                unit = units(matrix(rows.column("v")))
                for table in range(setting.tables):
                    best = buckets(unit, table, setting.rotations, probes)
                    at = pa.array(np.repeat(np.arange(len(unit)), best.shape[1]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(best.size, dim), pa.int32()), pa.array(np.full(best.size, table), pa.int32()), pa.array(best.ravel()), rows.column("vec_id").take(at), rows.column("nr").take(at), rows.column("v").take(at)], names=[c.split()[0] for c in HASHED.split(", ")])

    return vectors.mapInArrow(make, HASHED + vectors.schema["v"].dataType.simpleString())


def cosines(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Exact measure, summed in the same order for every pair, so equal vectors score alike."""
    one, many = scaled(one[None])[0], scaled(many)
    return (many * one).sum(axis=1) / (np.sqrt((one * one).sum()) * np.sqrt((many * many).sum(axis=1)))


FOUND = "query_id long, vec_id long, score double"


def best_of_block(queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """Each query's k nearest ids, those that rows repeat once, by the nearest."""
    ids, x = rows.column("vec_id").to_numpy(), matrix(rows.column("v"))
    asked, q = queries.column("vec_id").to_numpy(), matrix(queries.column("v"))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if len(ids) and len(asked):
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        once = len(starts) == len(ids)
        unit = units(x)
        for begin in range(0, len(asked), 256):
            rough = units(q[begin : begin + 256]) @ unit.T
            for j, s in enumerate(rough):
                one = asked[begin + j]
                s[ids == one] = -np.inf
                best = s if once else np.maximum.reduceat(s, starts)
                least = np.partition(best, len(best) - k)[len(best) - k] if len(best) > k else -np.inf
                near = np.flatnonzero((s >= least - 1e-9) & (s > -np.inf))
                exact = cosines(q[begin + j], x[near])
                first = np.lexsort((ids[near], -exact))
                first = first[:k] if once else first[np.sort(np.unique(ids[near][first], return_index=True)[1])][:k]
                out.append((np.full(len(first), one), ids[near][first], exact[first]))
    cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})


def _searched(queries: DataFrame, rows: DataFrame, setting: Setting, width: int, k: int) -> DataFrame:
    """The best k of each query in each block that it looks into."""
    key = ["dim", "tab", "bucket"]
    index, asked = hashed(rows, setting, 1), hashed(queries, setting, setting.probes)
    sizes = index.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).join(asked.groupBy(*key).agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("parts")), key)
    sizes = F.broadcast(sizes) if setting.tables * width**setting.rotations <= MOST_SENT else sizes
    place, every = lambda many: F.pmod(F.xxhash64("vec_id", "nr"), F.col(many)), lambda many: F.explode(F.sequence(F.lit(0).cast("long"), F.col(many) - 1))
    cut = index.join(sizes, key).withColumn("block", place("blocks")).withColumn("part", every("parts")).drop("blocks", "parts")
    asked = asked.join(sizes, key).withColumn("part", place("parts")).withColumn("block", every("blocks")).drop("blocks", "parts")
    full = [*key, "block", "part"]
    return asked.groupBy(*full).cogroup(cut.groupBy(*full)).applyInArrow(lambda q, r: best_of_block(q, r, k), FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k)


def _of_one_dim(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the commonest length."""
    dim = Counter(len(r.v) for r in rows).most_common(1)[0][0] if rows else 0
    some = [r for r in rows if len(r.v) == dim]
    return np.array([r.vec_id for r in some], dtype=np.int64), np.array([r.v for r in some], dtype=float).reshape(len(some), dim)


def choose(queries: DataFrame, rows: DataFrame, k: int = 5) -> tuple[Setting, float]:
    """The setting with the least work that finds ENOUGH, and the share of the sample's neighbours that it finds.

    queries, rows: vec_id, v. A sample of queries is searched exactly: each task holds its rows against all of the sample, and
    its best k go on. A pair is found if a table has the neighbour's bucket among the query's. If no setting finds enough,
    the one that finds most is taken.
    """
    by_hash = [F.xxhash64("vec_id"), "vec_id"]
    ids, q = _of_one_dim(queries.orderBy(*by_hash).limit(SAMPLE_QUERIES).collect())
    seen_ids, seen = _of_one_dim(rows.orderBy(*by_hash).limit(SAMPLE_VECTORS).collect())
    if not len(ids) or not len(seen) or q.shape[1] != seen.shape[1]:
        return Setting(8, 1, 12), 1.0
    asked = pa.table({"vec_id": pa.array(ids), "v": pa.array(q.tolist())})

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.compute.equal(pa.compute.list_value_length(batch.column("v")), q.shape[1]))
            yield from best_of_block(asked, pa.Table.from_batches([some]), k).to_batches()

    pairs = _ranked(rows.mapInArrow(best, FOUND), k).select("query_id", F.col("vec_id")).join(rows, "vec_id").select("query_id", "vec_id", "v").dropDuplicates(["query_id", "vec_id"]).collect()
    if not pairs:
        return Setting(8, 1, 12), 1.0
    n, at = rows.count(), {d: i for i, d in enumerate(ids.tolist())}
    one, other = np.array([at[r.query_id] for r in pairs]), units(np.array([r.v for r in pairs], dtype=float))
    unit_q, unit_seen = units(q), units(seen)
    results, width = [], 2 << max(0, int(q.shape[1] - 1).bit_length())
    for rotations in sorted({s.rotations for s in SETTINGS if s.rotations == 1 or 64 * width ** (s.rotations - 1) < n}):
        most = max(s.probes for s in SETTINGS if s.rotations == rotations)
        hit, share = [], []  # by table: at which probe each pair is found, and how much of the sample each probe reads on average
        for table in range(max(s.tables for s in SETTINGS)):
            probes, codes = buckets(unit_q, table, rotations, most), buckets(unit_seen, table, rotations, 1)[:, 0]
            same = probes[one] == buckets(other, table, rotations, 1)
            hit.append(np.where(same.any(axis=1), same.argmax(axis=1), most))
            ordered = np.sort(codes)
            share.append((np.searchsorted(ordered, probes, "right") - np.searchsorted(ordered, probes, "left")).mean(axis=0).cumsum() / len(seen))
        for s in (s for s in SETTINGS if s.rotations == rotations):
            found = float((np.array(hit[: s.tables]) < s.probes).any(axis=0).mean())
            read = sum(x[min(s.probes, len(x)) - 1] for x in share[: s.tables]) * n
            # a query's comparisons, its own rows that move, and its share of the vectors' rows that move
            results.append((found, read + MOVE * s.tables * (s.probes + n / max(1, len(ids) if len(ids) < SAMPLE_QUERIES else n / 50)), s))
    fine = [r for r in results if r[0] >= ENOUGH] or [max(results, key=lambda r: (r[0], -r[1]))]
    found, _, setting = min(fine, key=lambda r: r[1])
    return setting, found


def search(queries: DataFrame, vectors: DataFrame, k: int = 5, setting: Setting | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each query by cosine, ties to the smaller id.

    Rows with a null id, and vectors that are null, zero, or hold a null or a component that isn't finite, take no
    part. Vectors are compared with those of their own length. A row with the query's id is its own and
    isn't returned; rows that repeat an id count once, by the nearest. Queries for which the tables give fewer than
    k look into every bucket of one table, which is exact. An empty table gives no rows. Other columns aren't read.
    setting: as choose gives it, if none.
    """
    rows, asked = usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col)
    if setting is None:
        setting, _ = choose(asked, rows, k)
    dim = rows.agg(F.max(F.size("v"))).first()[0] or 1
    width = 2 << max(0, int(dim - 1).bit_length())
    found = stage(_ranked(_searched(asked, rows, setting, width, k), k), "neighbours")
    few = found.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("vec_id"))
    short = stage(asked.join(few, "vec_id", "left_anti"), "short")
    if not short.isEmpty():
        more = _searched(short, rows, Setting(1, 1, width), width, k)
        found = found.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(_ranked(more, k))
    return found.select("query_id", "rank", "vec_id", "score")
