"""Language identification, words first.

A word known from the learning texts scores by its log frequency in each language. An unseen one backs off to the
longest of its character n-grams that are known, five characters down to one. Each word's scores are made to
sum to one over the languages, so long or odd words don't outweigh the rest.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodex.llm.support import cache_for, only, share_below, small_batches, stage, sums_by_row, text_slices, words_of

#: Bounds of the sample that is learned from, and of the known words and n-grams by length (each language's most frequent ones).
SAMPLE_DOCS, SAMPLE_CHARS, MOST_WORDS, MOST_GRAMS, LONGEST = 12_000, 24_000_000, 60_000, 20_000, 5
#: Characters of a word, beyond which it is cut at what isn't a letter or mark; and how many count as a word in longer runs of these.
LONG, PIECE = 48, 16
#: Different n-grams that a task counts before it hands them on.
COUNTED = 200_000


def letters(word: str) -> str:
    """The word in lower case without what isn't a letter at its ends; empty if it has no letter."""
    begin, end = 0, len(word)
    while begin < end and not word[begin].isalpha():
        begin += 1
    while end > begin and not word[end - 1].isalpha():
        end -= 1
    return word[begin:end].lower()


def pieces(word: str) -> Iterator[tuple[str, str, int]]:
    """(word, the text to take its n-grams from with bounds, at how many places these begin).

    A long one gives its runs of letters; a long run gives parts that aren't words (""). These overlap, but each n-gram of the
    run begins in one of them, and none is made that isn't there.
    """
    if len(word) <= LONG:
        if core := letters(word):
            yield core, f"<{core}>", len(core) + 2
        return
    begin = 0
    while begin < len(word):
        end = begin
        while end < len(word) and _within(word[end]):
            end += 1
        if end - begin <= LONG:
            if core := letters(word[begin:end]):
                yield core, f"<{core}>", len(core) + 2
        elif any(map(str.isalpha, run := f"<{word[begin:end].lower()}>")):
            at, wide = 0, PIECE + LONGEST - 1
            while at + wide < len(run):
                yield "", run[at : at + wide], PIECE
                at += PIECE
            yield "", run[at:], wide
        begin = end + 1


def _within(c: str) -> bool:
    return c.isalpha() or category(c)[0] == "M"


def grams(held: str, n: int, places: int) -> list[str]:
    return [held[k : k + n] for k in range(min(places, len(held) - n + 1))]


class Model:
    """Log scores of known words and n-grams, a row each, so that exp() sums to one over the languages."""

    def __init__(self, languages: list[str], counts: dict[tuple[int, str], np.ndarray], totals: dict[int, np.ndarray], docs: np.ndarray):
        self.languages = languages
        self.prior = np.log((docs + 1.0) / (docs.sum() + len(languages))) if languages else np.zeros(0)
        sizes = Counter(n for n, _ in counts)
        # n-grams of different lengths differ, words have a table of their own
        self.known_words: dict[str, int] = {}
        self.known_grams: dict[str, int] = {}
        for k, (n, gram) in enumerate(counts):
            (self.known_grams if n else self.known_words)[gram] = k
        by_n = np.array([n for n, _ in counts], dtype=int)
        held = np.array(list(counts.values()), dtype=float).reshape(len(counts), len(languages))
        total = np.array([totals[n] for n in range(LONGEST + 1)])[by_n] if len(counts) else held
        s = np.log((held + 0.1) / (total + 0.1 * np.array([sizes[n] for n in by_n])[:, None])) if len(counts) else held
        self.rows = _to_one(s).astype(np.float32)
        self.key = blake2b(self.rows.tobytes() + repr(languages).encode(), digest_size=8).hexdigest()

    def words(self, words: list[str]) -> np.ndarray:
        """By word: its scores, then 1 if it has a letter; sums of these over its pieces. An unknown one has the mean of its longest known n-grams."""
        out = np.zeros((len(words), len(self.languages) + 1), dtype=np.float32)
        flat: list[int] = []
        at, ends = [], []
        known, grams_at = self.known_words.get, self.known_grams.get

        def add() -> None:
            starts = np.array([0, *ends[:-1]])
            mean = np.add.reduceat(self.rows[flat], starts, axis=0) / np.diff(np.array([0, *ends]))[:, None]
            np.add.at(out[:, :-1], at, _to_one(mean))
            for held in (flat, at, ends):
                held.clear()

        for k, w in enumerate(words):
            for core, held, places in pieces(w):
                out[k, -1] += 1
                if (row := known(core)) is not None:
                    flat.append(row)
                else:
                    for n in range(LONGEST, 0, -1):
                        if some := [r for g in grams(held, n, places) if (r := grams_at(g)) is not None]:
                            flat += some
                            break
                    else:
                        continue
                at.append(k)
                ends.append(len(flat))
                if len(flat) > COUNTED:
                    add()
        if at:
            add()
        return out


def _to_one(s: np.ndarray) -> np.ndarray:
    return s - np.logaddexp.reduce(s, axis=1, keepdims=True) if s.size else s


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, most_words: int = MOST_WORDS, most_grams: int = MOST_GRAMS) -> Model:
    """Learn from about sample_docs documents of sample_chars characters at most, chosen by the hash of id and text.

    Documents with a null text or language give nothing, and neither do empty ones; those of a null id are learned from like others.
    Repeated rows count each. An empty table gives a model that knows no language. Counting runs on the executors; the driver
    gets each language's most_words words and most_grams n-grams of each length: the vocabulary of a fitted model, which unseen
    words back off from. Ties go by the n-gram's order.
    """
    small_batches(docs.sparkSession)
    docs = only(docs, doc_id=id_col, text=text_col, lang=lang_col).dropna(subset=["text", "lang"])
    n, chars = docs.agg(F.count("*"), F.sum(F.length("text"))).first()
    # one very long text may make the whole too large, so it is left out before others are: texts of over a hundredth of the budget
    short = docs.where(F.length("text") <= sample_chars / 100)
    if (chars or 0) > sample_chars and (kept := short.agg(F.count("*"), F.sum(F.length("text"))).first())[0] >= n / 2:
        docs, n, chars = short, *kept
    share = min(1.0, sample_docs / max(1, n), sample_chars / max(1, chars or 0))
    sample = stage(docs.withColumn("key", F.concat_ws(" ", "doc_id", F.xxhash64("text"))).where(share_below("key", share)).drop("key") if share < 1 else docs, "sample")

    def made(lang: str, found: Counter[tuple[int, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array([m for m, _ in found], pa.int32()), pa.array([g for _, g in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "n", "gram", "many"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches):
            which, bounds, words = words_of(texts)
            langs = np.array(rows.column("lang").to_pylist(), dtype=object)
            by = np.repeat(np.arange(len(langs)), np.diff(bounds))
            for lang in dict.fromkeys(langs):
                found: Counter[tuple[int, str]] = Counter()
                of = np.bincount(which[langs[by] == lang], minlength=len(words)) if len(by) else np.zeros(0, dtype=int)
                for k in np.flatnonzero(of):
                    for core, held, places in pieces(words[k]):
                        if core:
                            found[0, core] += int(of[k])
                        for m in range(1, LONGEST + 1):
                            for g in grams(held, m, places):
                                found[m, g] += int(of[k])
                        if len(found) > COUNTED:
                            yield made(lang, found)
                            found.clear()
                yield made(lang, found)

    counts = stage(sample.select("text", F.col("lang").cast("string").alias("lang")).mapInArrow(count, "lang string, n int, gram string, many long").groupBy("n", "gram", "lang").agg(F.sum("many").alias("many")), "grams")
    total = counts.groupBy("n", "lang").agg(F.sum("many").alias("many")).collect()
    by_doc = dict(sample.groupBy(F.col("lang").cast("string")).count().collect())
    languages = sorted(by_doc)
    at = {lang: k for k, lang in enumerate(languages)}
    # ranked within each language, so that one with most rows leaves the others theirs
    place = F.row_number().over(Window.partitionBy("n", "lang").orderBy(F.desc("many"), "gram"))
    grouped = counts.withColumn("place", place).groupBy("n", "gram").agg(F.min("place").alias("place"), F.map_from_entries(F.collect_list(F.struct("lang", "many"))).alias("by"))
    best = grouped.where(F.col("place") <= F.when(F.col("n") == 0, most_words).otherwise(most_grams))
    table, totals = {}, {m: np.zeros(len(languages)) for m in range(LONGEST + 1)}
    for r in best.select("n", "gram", "by").toLocalIterator():
        row = table[r[0], r[1]] = np.zeros(len(languages))
        for lang, many in r[2].items():
            row[at[lang]] = many
    for m, lang, many in total:
        totals[m][at[lang]] = many
    return Model(languages, table, totals, np.array([by_doc[x] for x in languages], dtype=float))


PREDICTED = "doc_id long, lang_pred string, score double"


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (the chance of that language) of every whole text.

    Null texts and those without a letter are `und` with score 0, and so is every text if nothing was learned.
    Of languages that score alike the first by name is taken. Repeated rows each give a row; null ids
    stay null; an empty table gives no rows. Other columns aren't read.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MOST_WORDS and MOST_GRAMS a language

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        cache = cache_for(f"lang-{model.key}", model.words, len(model.languages) + 1)
        for rows, texts in text_slices(batches):
            which, bounds, words = words_of(texts)
            sums = sums_by_row(cache(words)[which], bounds)
            has = sums[:, -1] > 0 if model.languages else np.zeros(len(texts), dtype=bool)
            names, chance = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
            if has.any():
                s = sums[has, :-1] + model.prior
                best = s.argmax(axis=1)
                names[has] = np.array(model.languages, dtype=object)[best]
                chance[has] = np.clip(np.exp(s.max(axis=1) - np.logaddexp.reduce(s, axis=1)), 0, 1)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array(names, pa.string()), pa.array(chance)], names=[c.split()[0] for c in PREDICTED.split(", ")])

    return only(docs, doc_id=id_col, text=text_col).mapInArrow(make, PREDICTED)
