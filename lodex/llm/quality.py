"""Quality by ordinal cumulative-link regression on graded ratings.

One score per document, shared by all grades, and ordered thresholds between the grades:
P(grade >= k) = sigmoid(score - threshold k). The score is the mean of the words' scores, which are linear in
hashed features, plus weights of what the text repeats.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodex.llm.support import give_back, only, small_batches, sums_by_row, text_slices, words_of
from lodex.llm.toxicity import sigmoid
from lodex.llm.words import DIM, Adam, Features, documents_of, labelled_sample, word_scores

#: Bounds of the labelled sample that is learned from.
SAMPLE_DOCS, SAMPLE_CHARS = 6000, 10_000_000
STEPS, RATE, SHRINK = 150, 0.08, 1e-5
#: How much faster the few weights of repetition and length are learned than those of features.
LOUD = 5.0
#: A feature counts only if it was seen in so many documents (words of a document counted once).
SEEN = 3
#: Bounds of the shares of different words, of different word pairs, and of the number of words.
SHARES, LENGTHS = (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9), (0, 2, 8, 32, 128, 512, 2048, 8192)
WIDTH = 2 * (len(SHARES) + 1) + len(LENGTHS) + 1


@dataclass
class Model:
    weights: np.ndarray
    repeats: np.ndarray
    thresholds: np.ndarray
    grades: list[int] = field(default_factory=list)

def _different(codes: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """How many different codes each document has."""
    if not len(codes):
        return np.zeros(docs)
    order = np.lexsort((codes, doc))
    c, d = codes[order], doc[order]
    new = np.concatenate([[True], (c[1:] != c[:-1]) | (d[1:] != d[:-1])])
    return np.bincount(d[new], minlength=docs)


def repeats(which: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row per document: in which range the shares of different words and word pairs and the length lie."""
    n = np.diff(bounds)
    doc = np.repeat(np.arange(len(n)), n)
    pairs, same = which[:-1] * (which.max(initial=0) + 1) + which[1:], doc[:-1] == doc[1:]
    words = _different(which, doc, len(n)) / np.maximum(n, 1)
    double = _different(pairs[same], doc[:-1][same], len(n)) / np.maximum(n - 1, 1)
    out = np.zeros((len(n), WIDTH))
    step, k = len(SHARES) + 1, np.arange(len(n))
    out[k, np.searchsorted(SHARES, words)] = 1
    out[k, step + np.searchsorted(SHARES, double)] = 1
    out[k, 2 * step + np.searchsorted(LENGTHS, n)] = 1
    return out


def fit(texts: list[str], grades: np.ndarray) -> Model:
    """Learn from whole texts and their whole-number grades. With one grade only, every text gets it; with none, grade 0."""
    levels = sorted({int(g) for g in grades})
    if len(levels) < 2:
        return Model(np.zeros(DIM), np.zeros(WIDTH), np.zeros(0), levels or [0])
    y = np.searchsorted(levels, np.asarray(grades, dtype=int))
    which, bounds, words = words_of(pa.array([t.encode("utf-8", "replace") for t in texts], pa.large_binary()))
    spread = documents_of(which, bounds, len(words))
    give_back()
    made, extra = Features(words, spread, SEEN), repeats(which, bounds)
    give_back()
    n = np.maximum(np.diff(bounds), 1)
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    cuts, dim = len(levels) - 1, len(made.slots)
    extra *= LOUD
    x = np.zeros(dim + WIDTH + cuts)  # the last: the first threshold, and logs of the distances between the thresholds
    x[dim + WIDTH] = -1.0
    adam = Adam(len(x), RATE)
    rows = np.arange(len(y))
    for _ in range(STEPS):
        u = made.scores(x[:dim])
        score = np.bincount(doc, u[which], minlength=len(texts)) / n + extra @ x[dim : dim + WIDTH]
        gaps = np.exp(np.clip(x[dim + WIDTH + 1 :], -8, 8))
        at = x[dim + WIDTH] + np.concatenate([[0], np.cumsum(gaps)])
        above = np.column_stack([np.ones(len(y)), sigmoid(score[:, None] - at), np.zeros(len(y))])
        slope = above * (1 - above)
        p = np.maximum(above[rows, y] - above[rows, y + 1], 1e-12)
        dscore = -(slope[rows, y] - slope[rows, y + 1]) / p / len(y)
        dat = np.zeros(cuts)
        np.add.at(dat, y[y > 0] - 1, (slope[rows, y] / p / len(y))[y > 0])
        np.add.at(dat, y[y < cuts], -(slope[rows, y + 1] / p / len(y))[y < cuts])
        dgaps = np.cumsum(dat[::-1])[::-1][1:] * gaps
        by_word = np.bincount(which, (dscore / n)[doc], minlength=len(words))
        adam.step(x, np.concatenate([made.back(by_word) + SHRINK * x[:dim], extra.T @ dscore + SHRINK * x[dim : dim + WIDTH], [dat.sum()], dgaps]))
    gaps = np.exp(np.clip(x[dim + WIDTH + 1 :], -8, 8))
    return Model(made.spread_out(x[:dim]), LOUD * x[dim : dim + WIDTH], x[dim + WIDTH] + np.concatenate([[0], np.cumsum(gaps)]), levels)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Learn from at most about sample_docs graded documents of sample_chars characters, chosen by hash.

    Null ids, texts and labels give nothing to learn from. Empty texts count as texts without words, and long ones are learned from
    whole. Rows that repeat an id with the same text and label count once; if the labels differ, each counts. Without rows
    or with one label only, every text gets that label's verdict (none: the lowest). Other columns aren't read.
    """
    sample = labelled_sample(only(docs, doc_id=id_col, text=text_col), only(labels, doc_id=id_col, label=grade_col), sample_docs, sample_chars)
    model = fit(sample["text"].tolist(), sample["label"].to_numpy())
    del sample
    give_back()
    return model


def _graded(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Expected grade, and P(grade >= each grade but the least)."""
    which, bounds, words = words_of(texts)
    score = sums_by_row(word_scores(words, model.weights)[which], bounds) / np.maximum(np.diff(bounds), 1) + repeats(which, bounds) @ model.repeats
    above = sigmoid(score[:, None] - model.thresholds[None, :])
    levels = np.array(model.grades, dtype=float)
    return levels[0] + above @ np.diff(levels), above


GRADED = "expected_grade double, tail double"


def grade(docs: DataFrame, model: Model, at_least: int, text_col: str = "text") -> DataFrame:
    """All columns of docs, then expected_grade and tail: the chance of a grade of at_least or more.

    Texts without words (null, empty) get the grade of an empty text. Repeated rows are graded alike.
    An empty table gives no rows. A column of docs named like one of the two new ones is replaced.
    """
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("expected_grade", "tail")]
    docs = docs.select(*[docs[f"`{c}`"] for c in kept])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), GRADED])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIM weights
    k = int(np.searchsorted(model.grades, at_least))  # of no threshold: sure, or impossible

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches, text_col):
            expected, above = _graded(texts, shared.value)
            tail = np.ones(len(expected)) if k == 0 else above[:, k - 1] if k < len(model.grades) else np.zeros(len(expected))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(expected), pa.array(tail)], names=[*kept, "expected_grade", "tail"])

    return docs.mapInArrow(make, schema)


def select_quality(docs: DataFrame, model: Model, at_least: int, chance: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents, columns as they are, whose chance of a grade of at_least or more is at least so high."""
    return grade(docs, model, at_least, text_col).where(f"tail >= {chance}").select(*[f"`{c}`" for c in docs.columns if c not in ("expected_grade", "tail")])
