"""Hashed features of words, and models that are linear in them: a word's score is the sum of its features' weights."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodex.llm.support import share_below, stage

DIM = 1 << 20
#: Lengths of the character n-grams of a run of letters and digits with its bounds, and of runs of other signs.
GRAMS, SIGNS = (3, 4, 5), (1, 2)
#: Words whose features are made at a time.
CHUNK = 50_000
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: in lower case, whether a letter or digit, whether a capital. Those further on are letters."""
    signs = [chr(k) for k in range(0x20000)]
    lower = np.array([ord(x) if len(x := c.lower()) == 1 else ord(c) for c in signs], dtype=np.uint64)
    return lower, np.array([c.isalnum() for c in signs]), np.array([c.isupper() for c in signs])


def _slot(hashes: np.ndarray, kind: int) -> np.ndarray:
    x = (hashes + np.uint64(kind)) * A
    x = (x ^ (x >> np.uint64(31))) * B
    return (x >> np.uint64(44)).astype(np.int32)  # 20 bits: DIM


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the word, feature) of all words: n-grams and the whole of its runs in lower case, case, other signs."""
    codes = np.frombuffer("\n".join([*words, ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    lower, alnum, upper = _tables()
    near = np.minimum(codes, len(lower) - 1)
    letter = alnum[near] | (codes >= len(lower))
    low = np.where(letter, np.where(codes < len(lower), lower[near], codes.astype(np.uint64)), 0)
    word = np.cumsum(codes == 10) - (codes == 10)
    place, out_word, out = np.arange(len(codes)), [], []

    def add(at: np.ndarray, hashes: np.ndarray, kind: int) -> None:
        out_word.append(word[at].astype(np.int32))
        out.append(_slot(hashes, kind))

    # a sign outside a run is 0, which also marks a run's two bounds
    padded = np.concatenate([[0], low]).astype(np.uint64)  # padded[k + 1] is low[k]
    inner = np.concatenate([[False], letter])
    for n in GRAMS:
        if len(padded) >= n:
            h, fine = np.zeros(len(padded) - n + 1, dtype=np.uint64), np.ones(len(padded) - n + 1, dtype=bool)
            for k in range(n):
                h = h * A + padded[k : len(padded) - n + 1 + k]
                if 0 < k < n - 1:
                    fine &= inner[k : len(padded) - n + 1 + k]
            at = np.flatnonzero(fine)
            add(at, h[at], n)  # the middle of a window at k is low[k] or later, in the same word
    starts = np.flatnonzero(letter & ~np.concatenate([[False], letter[:-1]]))
    if len(starts):
        ends = np.flatnonzero(letter & ~np.concatenate([letter[1:], [False]]))
        run = np.cumsum(np.bincount(starts, minlength=len(codes)))[letter] - 1
        depth = (place[letter] - starts[run]) % 64
        power = np.cumprod(np.full(64, A, dtype=np.uint64), dtype=np.uint64)
        add(starts, np.add.reduceat(low[letter] * power[depth], np.searchsorted(place[letter], starts)), 7)
        capital = upper[near] & (codes < len(upper))
        many = np.add.reduceat(capital[letter], np.searchsorted(place[letter], starts), dtype=np.int64)
        add(starts, (np.where((many > 1) & (many == ends - starts + 1), 2, capital[starts])).astype(np.uint64), 8)
    other = ~letter & (codes != 10)
    at = np.flatnonzero(other)
    add(at, codes[at].astype(np.uint64), 9)
    pair = np.flatnonzero(other[:-1] & other[1:])
    add(pair, codes[pair].astype(np.uint64) * A + codes[pair + 1].astype(np.uint64), 10)
    return np.concatenate(out_word), np.concatenate(out)


def word_scores(words: list[str], weights: np.ndarray) -> np.ndarray:
    """Each word's sum of its features' weights."""
    out = np.zeros(len(words))
    for first in range(0, len(words), CHUNK):
        some = words[first : first + CHUNK]
        word, index = features(some)
        out[first : first + CHUNK] = np.bincount(word, weights[index], minlength=len(some))
    return out


class Features:
    """The features of many words, of those seen in so many documents; spread: in how many each word is."""

    def __init__(self, words: list[str], spread: np.ndarray, seen: int):
        chunks = range(0, len(words), CHUNK)
        found = np.zeros(DIM)
        for first in chunks:
            word, index = features(words[first : first + CHUNK])
            found += np.bincount(index, spread[first : first + CHUNK][word], minlength=DIM)
        held = found >= seen
        self.slots = np.flatnonzero(held)
        at = np.zeros(DIM, dtype=np.int32)
        at[self.slots] = np.arange(len(self.slots))
        self.words = len(words)
        some_words, some_slots = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for first in chunks:
            word, index = features(words[first : first + CHUNK])
            fine = held[index]
            some_words.append(word[fine] + np.int32(first))
            some_slots.append(at[index[fine]])
        self.word = np.concatenate(some_words)
        del some_words  # one list at a time is held twice
        self.index = np.concatenate(some_slots)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Each word's sum of weights, which are given by slot."""
        return self._summed(self.word, self.index, weights, self.words)

    def back(self, by_word: np.ndarray) -> np.ndarray:
        """Each slot's sum over its words."""
        return self._summed(self.index, self.word, by_word, len(self.slots))

    @staticmethod
    def _summed(to: np.ndarray, of: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(size)
        for first in range(0, len(to), 1 << 19):  # piece by piece, for memory
            some = slice(first, first + (1 << 19))
            out += np.bincount(to[some], values[of[some]], minlength=size)
        return out

    def drop(self, gone: np.ndarray) -> None:
        """Take the slots that are marked from all words; their numbers stay."""
        held = ~gone[self.index]
        self.word, self.index = self.word[held], self.index[held]

    def spread_out(self, weights: np.ndarray) -> np.ndarray:
        """Weights by feature."""
        out = np.zeros(DIM, dtype=np.float32)
        out[self.slots] = weights
        return out


def documents_of(which: np.ndarray, bounds: np.ndarray, words: int) -> np.ndarray:
    """In how many documents each word is."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    return np.bincount(np.unique(doc * max(1, words) + which) % max(1, words), minlength=words)


class Adam:
    """Step sizes for full-batch descent."""

    def __init__(self, size: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, x: np.ndarray, gradient: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (gradient - self.m)
        self.v += 0.01 * (gradient * gradient - self.v)
        x -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-8)


def labelled_sample(docs: DataFrame, labels: DataFrame, most_docs: int, most_chars: int) -> pd.DataFrame:
    """Texts with their labels, of about most_docs rows and most_chars characters at most.

    docs: doc_id, text. labels: doc_id, label. Rows with a null in any of these give nothing to learn from; rows that repeat an id with
    the same text and label count once. Rows are chosen by hash: first the labels, so many as most_docs; then rows
    in the order of their hash as long as most_chars isn't reached, those of over a hundredth of it last. So a very long text takes no
    other's place: it is taken only if it fits, and at least one row of each label is, however long.
    """
    labels = labels.dropna().distinct()
    share = min(1.0, most_docs / max(1, labels.count()))
    some = labels.where(share_below("doc_id", share)) if share < 1 else labels
    # the bound on the sample is one on what is broadcast, as its rows differ
    joined = docs.dropna().join(F.broadcast(some), "doc_id").dropDuplicates(["doc_id", "text", "label"])
    found = stage(joined.withColumn("nth", F.monotonically_increasing_id()), "sample")
    sizes = found.select("nth", "label", F.length("text").alias("chars"), F.xxhash64("doc_id", "text", "label").alias("hash")).orderBy("hash", "nth").limit(4 * most_docs).toPandas()
    taken = within_budget(sizes["chars"].to_numpy(), sizes["label"].to_numpy(), most_chars)
    if len(taken) < found.count():
        found = found.join(F.broadcast(docs.sparkSession.createDataFrame([(int(x),) for x in sizes["nth"].to_numpy()[taken]], "nth long")), "nth", "left_semi")
    return found.drop("nth").orderBy("doc_id", "text", "label").toPandas()


def within_budget(chars: np.ndarray, labels: np.ndarray, most: int) -> np.ndarray:
    """Numbers of the rows that are taken: the shortest of each label, then those that fit, with the ones of over a hundredth of the budget last."""
    first = np.array([np.flatnonzero(labels == x)[chars[labels == x].argmin()] for x in pd.unique(labels)], dtype=np.int64)
    order = np.concatenate([first, np.flatnonzero(chars <= most / 100), np.flatnonzero(chars > most / 100)]).astype(np.int64)
    order = order[np.sort(np.unique(order, return_index=True)[1])]
    left, taken = most, []
    for k in order.tolist():
        if chars[k] <= left or k in first:
            taken.append(k)
            left -= int(chars[k])
    return np.sort(np.array(taken, dtype=np.int64))
