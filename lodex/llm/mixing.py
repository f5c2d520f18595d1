"""Mixing sources to target weights by balanced sampling with the cube method.

Each source gets a target by weights that repeat over the sources in order, at most `most` times its size. A document is
to be taken target/size times on average: the whole part for sure, the rest with that chance. The cube method
moves these chances along directions in which neither the words nor the documents that a source gives
change, until all but a few are 0 or 1. Sources are dealt into blocks of a fixed size by hash, so the
largest source is spread over many tasks; what is left of the blocks is moved again in blocks, and
a last small landing problem decides the rest by drawing closest to the targets.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodex.llm.support import numbered, stage, with_rows

#: Documents in a block of the first flight on average.
BLOCK = 8192
#: Sources, whose totals are gathered at the driver.
MOST_SOURCES = 200_000
WORD = r"[^\x20\x09-\x0D]+"
NEAR = 1e-9


def word_count(column):
    """Number of runs of characters other than space and \\x09-\\x0D; null: 0."""
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], share: float = 1.5, weights: Sequence[float] = (3, 1, 2), most: float = 2.0) -> list[float]:
    """Target of each source: share of all sizes by weight, none above `most` times its size, the excess dealt anew."""
    weigh = np.array([weights[k % len(weights)] for k in range(len(sizes))], dtype=float)
    caps = np.array(sizes, dtype=float) * most
    out, free, left = np.zeros(len(sizes)), np.ones(len(sizes), dtype=bool), float(sum(sizes)) * share
    while free.any():
        dealt = left * weigh / weigh[free].sum()
        over = free & (dealt > caps)
        if not over.any():
            out[free] = dealt[free]
            break
        out[over] = caps[over]
        left -= caps[over].sum()
        free &= ~over
    return out.tolist()


def flight(chance: np.ndarray, balance: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move chances until at most as many as `balance` has columns lie strictly between 0 and 1.

    balance[k] holds what document k adds to each constraint per unit of chance. Each step takes one
    more document than there are constraints, so a direction that keeps all sums exists.
    """
    p = balance.shape[1]
    chance = chance.copy()
    queue = np.flatnonzero((chance > NEAR) & (chance < 1 - NEAR)).tolist()
    held: list[int] = []
    while True:
        while len(held) <= p and queue:
            held.append(queue.pop())
        if len(held) <= p:
            break
        a = balance[held].T
        direction = np.linalg.svd(a)[2][-1] if p != 2 else _kernel(a)
        x = chance[held]
        up = down = np.inf
        for d, v in zip(direction.tolist(), x.tolist(), strict=True):
            if d > NEAR:
                up, down = min(up, (1 - v) / d), min(down, v / d)
            elif d < -NEAR:
                up, down = min(up, -v / d), min(down, (v - 1) / d)
        step = up if rng.random() * (up + down) < down else -down
        x = np.clip(x + step * direction, 0, 1)
        chance[held] = x
        held = [k for k, v in zip(held, x.tolist(), strict=True) if NEAR < v < 1 - NEAR]
    return np.where(chance < NEAR, 0.0, np.where(chance > 1 - NEAR, 1.0, chance))


def _kernel(a: np.ndarray) -> np.ndarray:
    """A unit vector orthogonal to two rows of three numbers."""
    u = np.array([a[0, 1] * a[1, 2] - a[0, 2] * a[1, 1], a[0, 2] * a[1, 0] - a[0, 0] * a[1, 2], a[0, 0] * a[1, 1] - a[0, 1] * a[1, 0]])
    if (n := np.abs(u).max()) < 1e-12 * max(1.0, np.abs(a).max()):  # both constraints say the same of these documents
        return np.linalg.svd(a)[2][-1]
    return u / n


def landing(chance: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """0 or 1 for the few undecided ones: of random draws, the one that brings words and then documents nearest."""
    out = chance.copy()
    open_ = np.flatnonzero((chance > NEAR) & (chance < 1 - NEAR))
    if not len(open_):
        return out
    draws = rng.random((256, len(open_))) < chance[open_]
    words = np.abs(draws @ size[open_] - chance[open_] @ size[open_])
    count = np.abs(draws.sum(axis=1) - chance[open_].sum())
    out[open_] = draws[np.lexsort((count, words))[0]]
    return out


def _flown(rows: DataFrame, key: list[str], last: bool) -> DataFrame:
    """chance after a flight (and a landing) over each group of `key`; rows keep the place of their hash."""

    def fly(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["order", "row"]).reset_index(drop=True)
        rng = np.random.default_rng(np.abs(group["order"].to_numpy()[:1]))
        size = group["size"].to_numpy(dtype=float)
        chance = flight(group["chance"].to_numpy(), np.column_stack([size / max(1.0, size.mean()), np.ones(len(size))]), rng)
        group["chance"] = landing(chance, size, rng) if last else chance
        return group

    return rows.groupBy(*key).applyInPandas(fly, rows.schema)


def mix(docs: DataFrame, share: float = 1.5, weights: Sequence[float] = (3, 1, 2), most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """doc_id, row, size, source_size, target, times, taken of every document; taken is times the size.

    Sources go by code point, null last as a source of its own. Texts without words (null, empty) have size 0,
    are counted once if their share asks for it, and take no words. A document's chance depends on its id and
    text alone, so reruns agree; repeated rows are drawn one by one in a fixed order. A table without words has
    targets of 0. An empty table gives no rows. Other columns aren't read. The sources' totals, one
    row each and MOST_SOURCES at most (more is an error), go to the driver; their texts don't. row_col: a number of each row that tells rows alike apart,
    given back as row; else one is made.
    """
    if row_col is None:
        docs, row_col = numbered(docs, "lodex_row"), "lodex_row"
    order = F.xxhash64(F.col("doc_id"), F.col("text"))
    rows = stage(with_rows(docs, row_col, doc_id=id_col, text=text_col, source=source_col).select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), order.alias("order"), "row"), "sizes")
    by_source = rows.groupBy("source").agg(F.sum("size"), F.count("*")).limit(MOST_SOURCES + 1).collect()
    if len(by_source) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    sums = sorted(by_source, key=lambda r: (r[0] is None, r[0] or ""))
    aims = targets([r[1] for r in sums], share, weights, most)
    facts = [(r[0], r[1], aim, aim / r[1] if r[1] else 0.0, max(1, -(-r[2] // BLOCK))) for r, aim in zip(sums, aims, strict=True)]
    table = docs.sparkSession.createDataFrame(facts, "source string, source_size long, target double, per_doc double, blocks long")
    rows = rows.alias("d").join(table.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.*", "source_size", "target", F.floor("per_doc").cast("int").alias("whole"), (F.col("per_doc") - F.floor("per_doc")).alias("chance"), "blocks")
    # rows alike that would overfill a block are dealt over all; which of them is which makes no difference
    hot = rows.groupBy("order").count().where(F.col("count") > BLOCK).select("order", F.lit(True).alias("hot"))  # at most a row in BLOCK
    rows = rows.join(F.broadcast(hot), "order", "left").withColumn("salt", F.when(F.col("hot"), F.col("row")).otherwise(0)).drop("hot")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("order", "salt", F.lit(1)), F.col("blocks")))
    most_blocks = max([f[4] for f in facts], default=1)
    few = ["row", "source", "size", "order", "salt", "chance", "blocks", "block"]
    now = stage(_flown(rows.select(*few), ["source", "block"], most_blocks == 1), "flight")
    decided = []
    while most_blocks > 1:  # each block left two undecided at most, so the next round has a few thousandths of the rows
        undecided = (F.col("chance") > 0) & (F.col("chance") < 1)
        decided.append(now.where(~undecided))
        most_blocks = -(-most_blocks * 2 // BLOCK)
        fewer = now.where(undecided).withColumn("blocks", F.ceil(F.col("blocks") * 2 / BLOCK)).withColumn("block", F.pmod(F.xxhash64("order", "salt", F.lit(1)), F.col("blocks")))
        now = stage(_flown(fewer.select(*few), ["source", "block"], most_blocks == 1), "flight")
    for part in decided:
        now = now.unionByName(part)
    drawn = rows.select("doc_id", "row", "size", "source_size", "target", "whole").join(now.select("row", "chance"), "row")
    times = (F.col("whole") + F.round("chance").cast("int")).alias("times")
    return drawn.select("doc_id", "row", "size", "source_size", "target", times).withColumn("taken", F.col("times") * F.col("size"))
