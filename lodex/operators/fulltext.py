"""Full-text search that opens few postings.

Postings are packed by block of documents: a row holds a term's postings in one block, with how many they are, the greatest
count of the term and the least length of a document. These bound what the block's documents can score, whatever the query's
other terms and the mean length. The k blocks of the greatest bounds are scored first, exactly; the k-th best score
there is one that all others must reach, so only blocks whose bound does are opened. No document is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodex.config import BM25_B, BM25_K1

#: Blocks that may be sent to all tasks as a list; more are met by a join on their key.
MOST_SENT = 200_000
#: Scores have six digits; two that the order of adding could make unequal differ by less than this.
SLACK = 1.5e-6


def packed(held: DataFrame, block: str = "path") -> DataFrame:
    """block, term, n, top_tf, least_len, held (id, len, tf) of postings (block, id, len, term, tf).

    A row is as large as its block, so blocks are of a bounded number of documents: the records of one file, or a range of ids.
    """
    return held.groupBy(block, "term").agg(F.count("*").alias("n"), F.max("tf").alias("top_tf"), F.min("len").alias("least_len"), F.array_sort(F.collect_list(F.struct("id", "len", "tf"))).alias("held"))


def unpacked(blocks: DataFrame, block: str = "path") -> DataFrame:
    """The postings: block, id, len, term, tf."""
    return blocks.select(block, "term", F.explode("held").alias("h")).select(block, "h.id", "h.len", "term", "h.tf")


@dataclass(frozen=True)
class Weights:
    """What a query's terms weigh, and the mean length."""

    idf: dict[str, float]
    avg_len: float

    def score(self, tf: Column, length: Column) -> Column:
        """What a row's term adds to a document's score. It grows with tf and falls with the length."""
        idf = F.create_map(*[F.lit(x) for x in chain.from_iterable(self.idf.items())])[F.col("term")]
        return idf * tf * (BM25_K1 + 1) / (tf + BM25_K1 * ((1 - BM25_B) + BM25_B * length / self.avg_len))


def weights(blocks: DataFrame, sums: DataFrame, query: Iterable[str]) -> Weights:
    """Of the query's terms that occur. sums: one row (n, avg_len). No postings are opened: blocks hold their numbers."""
    terms = list(dict.fromkeys(query))
    df = {r.term: r.df for r in blocks.where(F.col("term").isin(*terms)).groupBy("term").agg(F.sum("n").alias("df")).collect()}  # a row for each query term
    total = sums.first()
    return Weights({t: math.log(1 + (total.n - df[t] + 0.5) / (df[t] + 0.5)) for t in terms if t in df}, float(total.avg_len or 1.0))


def bounds(blocks: DataFrame, weighed: Weights, block: str = "path") -> DataFrame:
    """block, bound, n_held: what no document of the block scores more than, and how many postings of the query it has."""
    some = blocks.where(F.col("term").isin(*weighed.idf))
    return some.groupBy(block).agg(F.round(F.sum(weighed.score(F.col("top_tf"), F.col("least_len"))), 6).alias("bound"), F.sum("n").alias("n_held"))


def _scores(blocks: DataFrame, weighed: Weights, wanted: DataFrame, block: str) -> DataFrame:
    """id, score of the documents of the wanted blocks; only their postings are opened."""
    some = unpacked(blocks.where(F.col("term").isin(*weighed.idf)).join(wanted.select(block), block, "left_semi"), block)
    return some.groupBy("id").agg(F.round(F.sum(weighed.score(F.col("tf"), F.col("len"))), 6).alias("score"))


def openable(blocks: DataFrame, weighed: Weights, k: int, block: str = "path") -> DataFrame:
    """block, bound, n_held of the blocks that can hold one of the k best documents.

    A document is in one block alone, so k blocks hold k documents with a term at least. Where there are fewer blocks, all can.
    """
    every = bounds(blocks, weighed, block)
    first = F.broadcast(every.orderBy(F.desc("bound"), block).limit(k))  # k rows
    least = _scores(blocks, weighed, first, block).orderBy(F.desc("score"), "id").limit(k).agg(F.count("*").alias("n"), F.min("score").alias("score")).first()
    return every if least.n < k else every.where(F.col("bound") + SLACK >= least.score)


def top(blocks: DataFrame, sums: DataFrame, query: Iterable[str], k: int, block: str = "path") -> DataFrame:
    """id, score of the k best documents, ties by id: the same rows as scoring all postings gives.

    blocks: as packed makes them, at rest, since they are read more than once, at first without what they hold. Terms that don't occur
    add nothing; without one that does there are no rows. Repeated terms count once.
    """
    weighed = weights(blocks, sums, query)
    if not weighed.idf:
        return unpacked(blocks, block).select("id", F.lit(0.0).alias("score")).limit(0)
    wanted = openable(blocks, weighed, k, block).select(block)
    if wanted.limit(MOST_SENT + 1).count() <= MOST_SENT:
        wanted = F.broadcast(wanted)
    return _scores(blocks, weighed, wanted, block).orderBy(F.desc("score"), "id").limit(k)


def opened(blocks: DataFrame, sums: DataFrame, query: Iterable[str], k: int, block: str = "path") -> DataFrame:
    """One row: blocks, opened_blocks, postings, opened_postings of a search for the k best documents."""
    weighed = weights(blocks, sums, query)
    count = lambda df, p: df.agg(F.count("*").alias(f"{p}blocks"), F.coalesce(F.sum("n_held"), F.lit(0)).cast("long").alias(f"{p}postings"))
    if not weighed.idf:
        return count(blocks.select(F.lit(0).alias("n_held")).limit(0), "").crossJoin(count(blocks.select(F.lit(0).alias("n_held")).limit(0), "opened_"))  # a row each
    return count(bounds(blocks, weighed, block), "").crossJoin(count(openable(blocks, weighed, k, block), "opened_"))  # a row each
