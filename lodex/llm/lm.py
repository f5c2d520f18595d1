"""Stupid-backoff language-model scores, computed relationally.

Texts are dealt into blocks. Each block sends its different n-grams, as sorted hashes, to the parts of the
count tables, which are partitioned by hash; each part adds up the blocks' counts and sends each block the
counts of its own n-grams back. Joined to the block's exploded n-grams, they give each word's score,
and these are summed by document.

Every n-gram counts. It travels once per block, however often it occurs there, and only if both n-grams that it
extends occur outside the block too; if one of them doesn't, neither does the n-gram, and the block's own count is
the corpus'.

Hashes have 64 bits; n-grams of the same length whose hashes are equal count as one. Of n different ones about n^2 / 2^65
pairs are: none to be expected among a billion, some ten thousand among a trillion.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodex.llm.mixing import word_count
from lodex.llm.support import only, small_batches, text_bytes, text_slices, words_of

#: Characters of a block, and n-grams of a part of the count tables on average.
BLOCK_CHARS, PART_GRAMS = 14_000_000, 2_000_000
A, B, C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * B
    return x ^ (x >> np.uint64(29))


def gram_hashes(texts: pa.Array, order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """By length n: the hash of the n-gram that ends at each word, if it begins in the text; each word's place in its text; the words' bounds by text."""
    import xxhash

    which, bounds, words = words_of(texts, as_bytes=True)
    of = np.array([xxhash.xxh64_intdigest(w, 7) for w in words], dtype=np.uint64)
    one = of[which] if len(which) else np.zeros(0, dtype=np.uint64)
    place = np.arange(len(which)) - np.repeat(bounds[:-1], np.diff(bounds))
    hashes = [one]
    for n in range(2, order + 1):
        longer = np.zeros_like(one)
        longer[1:] = _mixed(hashes[-1][:-1] * A + one[1:] * C + np.uint64(n))
        hashes.append(longer)
    return hashes, place, bounds


def _squeezed(values: np.ndarray, width: int) -> bytes:
    """Values of so many bytes each; the few that don't fit are marked, and follow whole."""
    mark = np.uint64((1 << (8 * width)) - 1)
    large = values >= mark
    low = np.where(large, mark, values).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + np.ascontiguousarray(low).tobytes() + values[large].astype("<u8").tobytes()


def _unsqueezed(data: bytes, many: int) -> np.ndarray:
    width = data[0]
    out = np.zeros((many, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(data, dtype=np.uint8, offset=1, count=many * width).reshape(-1, width)
    values = out.view("<u8")[:, 0].copy()
    values[values == np.uint64((1 << (8 * width)) - 1)] = np.frombuffer(data, dtype="<u8", offset=1 + many * width)
    return values


def packed(numbers: np.ndarray) -> bytes:
    """Ascending 64-bit numbers as their count, the first one, and their distances in as few bytes as nearly all need."""
    if not len(numbers):
        return b""
    steps = np.diff(numbers)
    width = max(1, min(7, (int(np.quantile(steps, 0.99)).bit_length() + 7) // 8)) if len(steps) else 1
    return np.array([len(numbers), numbers[0]], dtype="<u8").tobytes() + _squeezed(steps, width)


def unpacked(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, dtype=np.uint64)
    many, first = np.frombuffer(data, dtype="<u8", count=2)
    return np.cumsum(np.concatenate([[first], _unsqueezed(data[16:], int(many) - 1)]).astype(np.uint64), dtype=np.uint64)


def packed_counts(counts: np.ndarray) -> bytes:
    """A byte each but for large ones."""
    return len(counts).to_bytes(8, "little") + _squeezed(counts.astype(np.uint64), 1)


def unpacked_counts(data: bytes) -> np.ndarray:
    return _unsqueezed(data[8:], int.from_bytes(data[:8], "little")).astype(np.int64)


SENT = "block long, model boolean, n int, part int, hashes binary, counts binary"
BACK = "block long, n int, part int, counts binary"
SCORED = "doc_id long, n_words long, log10_score double"


def _back(back: pa.Table | None, n: int) -> np.ndarray:
    """The counts that came back for the n-grams a block sent, in the order of their hashes."""
    got = sorted(zip(back.column("part").to_pylist(), back.column("n").to_pylist(), back.column("counts").to_pylist(), strict=True), key=lambda r: r[:2]) if back is not None else []
    return np.concatenate([np.zeros(0, np.int64), *(unpacked_counts(c) for _, m, c in got if m == n)])


class Block:
    """The n-grams of a block's texts. own: its counts are part of the corpus; closed: and nobody else asks for what only it has."""

    def __init__(self, rows: pa.Table, order: int):
        model = rows.column("model")[0].as_py()
        self.own, self.closed = model is not False, model is None
        self.hashes, self.place, self.bounds = gram_hashes(_texts(rows), order)
        self.outside: np.ndarray | None = None  # by word: whether the longest n-gram counted so far that ends there occurs outside the block

    def to_send(self, n: int) -> np.ndarray:
        """By word: whether the n-gram that ends there is sent. It's sent if both shorter ones occur outside; one of them ends a word earlier."""
        if self.outside is None:
            return self.place >= n - 1
        return (self.place >= n - 1) & self.outside & np.concatenate([[False], self.outside[:-1]])

    def count(self, n: int, back: pa.Table | None, within: bool = False) -> np.ndarray:
        """By word: the corpus' count of the n-gram that ends there, 0 where there is none; within: less those in the text itself."""
        there = self.place >= n - 1
        different, number, local = np.unique(self.hashes[n - 1][there], return_inverse=True, return_counts=True)
        sent = np.bincount(number, self.to_send(n)[there], minlength=len(different)) > 0
        total = local.astype(np.int64) if self.own else np.zeros(len(different), dtype=np.int64)
        total[sent] = _back(back, n)
        self.outside = np.zeros(len(there), dtype=bool)
        self.outside[there] = (total > local if self.closed else total > 0)[number]
        found = total[number]
        if within and self.own:
            one = found == 1  # it's the text's own
            found[one] = 0
            doc = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))[there][~one]
            _, pair, many = np.unique(doc * max(1, len(different)) + number[~one], return_inverse=True, return_counts=True)
            found[~one] -= many[pair]
        counts = np.zeros(len(there), dtype=np.int64)
        counts[there] = found
        return counts


def sent(rows: pa.Table, back: pa.Table | None, n: int, bits: int) -> pa.Table:
    """The different n-grams of a block by part, each with its count there. Part: the hash's first bits."""
    if not len(rows):
        return _table([], SENT)
    id_, model = rows.column("block")[0].as_py(), rows.column("model")[0].as_py()
    block = Block(rows, n)
    for m in range(1, n):
        block.count(m, back)
    found, counts = np.unique(block.hashes[n - 1][block.to_send(n)], return_counts=True)
    cuts = np.concatenate([np.searchsorted(found, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else [0], [len(found)]])
    out = [(id_, model, n, part, packed(found[a:b]), packed_counts(counts[a:b])) for part, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if b > a]
    return _table(out, SENT)


def counted(rows: pa.Table) -> pa.Table:
    """One part's total counts, for each block that asks: its own n-grams' counts in the order they came."""
    hashes = [unpacked(h) for h in rows.column("hashes").to_pylist()]
    counts = [unpacked_counts(c) for c in rows.column("counts").to_pylist()]
    model, block = rows.column("model").to_pylist(), rows.column("block").to_pylist()
    n, part = rows.column("n")[0].as_py(), rows.column("part")[0].as_py()
    found, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
    weigh = np.concatenate([c if m is not False else np.zeros_like(c) for c, m in zip(counts, model, strict=True)])
    total = np.bincount(inverse, weigh, minlength=len(found)).astype(np.int64)
    out, at = [], 0
    for k, h in enumerate(hashes):
        out.append((block[k], n, part, packed_counts(total[inverse[at : at + len(h)]])))
        at += len(h)
    return _table(out, BACK)


def scored(rows: pa.Table, back: pa.Table, order: int, words: int, alpha: float, least: int) -> pa.Table:
    """Sum of log10 scores of each document of a block. A text of the corpus is scored by the other texts' counts."""
    if not len(rows):
        return _table([], SCORED)
    block = Block(rows, order)
    many, total = np.diff(block.bounds), words
    log = shorter = None
    for n in range(1, order + 1):
        counts = block.count(n, back, within=True)
        block.hashes[n - 1] = None
        if block.own:
            total = words - np.repeat(many, many)
        if log is None:
            log = np.log10(np.maximum(counts, 0.5)) - np.log10(np.maximum(1, total))
        else:
            before = np.concatenate([[0], shorter[:-1]])  # the n-gram's first n - 1 words end one word earlier
            log = np.where((block.place >= n - 1) & (counts >= least), np.log10(np.maximum(counts, 1)) - np.log10(np.maximum(before, 1)), np.where(block.place >= n - 1, math.log10(alpha) + log, log))
        shorter = counts
    sums = np.add.reduceat(np.append(log, 0.0), block.bounds[:-1]) if len(block.bounds) > 1 else np.zeros(0)
    sums = np.where(many > 0, sums, 0.0)
    return pa.table({"doc_id": rows.column("doc_id").cast(pa.int64()), "n_words": pa.array(many, pa.int64()), "log10_score": pa.array(sums)})


def zipped(docs: DataFrame) -> DataFrame:
    """doc_id, model, block, zip: texts compressed for the shuffle, which moves them once."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for rows, texts in text_slices(batches):
            packed_texts = [len(t).to_bytes(8, "little") + codec.compress(t, asbytes=True) for t in text_bytes(texts)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), rows.column("model"), rows.column("block"), pa.array(packed_texts, pa.binary())], names=["doc_id", "model", "block", "zip"])

    return docs.select("doc_id", "model", "block", "text").mapInArrow(make, "doc_id long, model boolean, block long, zip binary")


def _texts(rows: pa.Table) -> pa.Array:
    codec = pa.Codec("zstd")
    return pa.array([codec.decompress(z[8:], int.from_bytes(z[:8], "little"), asbytes=True) for z in rows.column("zip").to_pylist()], pa.large_binary())


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "double": pa.float64()}
    names = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.table({n: pa.array(list(c), kinds[k]) for (n, k), c in zip(names, columns, strict=True)})


def score(docs: DataFrame, corpus: DataFrame | None = None, order: int = 3, alpha: float = 0.4, least: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, log10_score (sum over the words), mean_log10 (null without words).

    Words are runs of characters other than space and \\x09-\\x0D. A word's score is count(n-gram) / count(its first
    n - 1 words) for the longest n-gram ending there that occurs at least `least` times in the corpus, times alpha for
    each shorter step (least is 1 or more); a single word's is count / words of the corpus, where unseen ones count as a half.
    corpus: the texts to count. Without it they are docs themselves, and each is scored by the counts of all others: its
    own n-grams are no evidence for it. Null and empty texts have no words and score 0. Repeated rows are texts of their own,
    so each is evidence for the others. Null ids stay null. Empty tables give no rows. Other columns aren't read.
    """
    small_batches(docs.sparkSession)
    docs = only(docs, doc_id=id_col, text=text_col).withColumn("model", F.lit(None).cast("boolean"))
    counted_of = docs
    if corpus is not None:
        docs = docs.withColumn("model", F.lit(False))
        counted_of = only(corpus, text=text_col).select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(True).alias("model"))
    every = docs if corpus is None else docs.unionByName(counted_of)
    chars, words = every.agg(F.sum(F.length("text")), F.sum(F.when(F.coalesce("model", F.lit(True)), word_count(F.col("text"))).otherwise(0))).first()
    chars, words = chars or 0, words or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))
    bits = [max(0, math.ceil(math.log2(max(1, words * share / PART_GRAMS)))) for share in (0.25, *[1.0] * (order - 1))]
    # repeated rows are dealt over all blocks
    block = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(blocks)) + F.when(F.coalesce("model", F.lit(False)), F.lit(blocks)).otherwise(0)
    dealt = lambda df: zipped(df.withColumn("block", block))

    def sending(n: int):
        return lambda rows, back: sent(rows, back, n, bits[n - 1])

    texts, back = dealt(every), None
    for n in range(1, order + 1):  # one plan: its text is dealt once, and each round reads that again
        if back is None:
            grams = texts.groupBy("block").applyInArrow(lambda t: sent(t, None, 1, bits[0]), SENT)
        else:
            grams = texts.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(sending(n), SENT)
        found = grams.groupBy("n", "part").applyInArrow(counted, BACK)
        back = found if back is None else back.unionByName(found)
    scored_texts = texts if corpus is None else dealt(docs)
    made = scored_texts.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(lambda d, b: scored(d, b, order, words, alpha, least), SCORED)
    return made.withColumn("mean_log10", F.when(F.col("n_words") > 0, F.col("log10_score") / F.col("n_words")))
