"""Toxicity by multiple-instance learning.

A document is toxic if any of its sentences is: P = 1 - prod(1 - p(sentence)), noisy-or. Only documents
have labels; sentences learn theirs through P, so the model can tell which sentence offends.
A sentence's logit is linear in its words' hashed features. No weight is below 0, for a word can offend
but none can excuse another, and each unit of weight has a price, so few features get any.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodex.llm.support import only, small_batches, text_slices, words_of
from lodex.llm.words import DIM, Adam, Features, documents_of, labelled_sample, word_scores

#: Bounds of the labelled sample that is learned from.
SAMPLE_DOCS, SAMPLE_CHARS = 6000, 10_000_000
#: Words after which a sentence without an end is cut.
LONGEST = 40
STEPS, RATE, SHRINK = 120, 0.1, 1e-4
#: A feature counts only if it was seen in so many documents (words of a document counted once).
SEEN = 4


@dataclass
class Model:
    weights: np.ndarray
    bias: float

def sentence_numbers(which: np.ndarray, bounds: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Each word's sentence, and the sentences' bounds by document. A sentence ends with a word in .!? or after LONGEST words."""
    n = len(which)
    ends = np.array([w[-1] in ".!?" for w in words], dtype=bool)[which] if n else np.zeros(0, dtype=bool)
    begin = np.zeros(n, dtype=bool)
    begin[1:] = ends[:-1]
    begin[bounds[:-1][bounds[:-1] < n]] = True
    first = np.maximum.accumulate(np.where(begin, np.arange(n), 0)) if n else np.zeros(0, dtype=np.int64)
    begin |= (np.arange(n) - first) % LONGEST == 0
    number = np.cumsum(begin) - 1
    count = np.concatenate([[0], np.cumsum(begin)])
    return number, count[bounds]


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return np.exp(-softplus(-z))


def fit(texts: list[str], labels: np.ndarray) -> Model:
    """Learn from whole texts. With one label only, or none, every sentence gets that label's share as its score."""
    labels = np.asarray(labels, dtype=float)
    if len(labels) == 0 or labels.min() == labels.max():
        return Model(np.zeros(DIM), 8.0 if len(labels) and labels[0] > 0.5 else -8.0)
    which, bounds, words = words_of(pa.array([t.encode("utf-8", "replace") for t in texts], pa.large_binary()))
    number, by_doc = sentence_numbers(which, bounds, words)
    total = int(by_doc[-1])
    doc = np.repeat(np.arange(len(texts)), np.diff(by_doc))
    made = Features(words, documents_of(which, bounds, len(words)), SEEN)
    rare = labels.mean()
    weigh = np.where(labels > 0, 0.5 / rare, 0.5 / (1 - rare)) / len(labels)
    x = np.zeros(len(made.slots) + 1)
    x[-1] = -6
    adam = Adam(len(x), RATE)
    for step in range(STEPS):
        if step in (20, 50):  # what has no weight by now gets none
            made.drop(x[:-1] == 0)
        u = made.scores(x[:-1])
        z = np.bincount(number, u[which], minlength=total) + x[-1]
        clean = np.bincount(doc, softplus(z), minlength=len(texts))  # -log of the chance that no sentence is toxic
        outer = np.where(labels > 0, -np.exp(-clean) / np.maximum(1e-12, -np.expm1(-clean)), 1.0) * weigh
        dz = outer[doc] * sigmoid(z)
        gradient = np.concatenate([made.back(np.bincount(which, dz[number], minlength=len(words))) + SHRINK, [dz.sum()]])
        adam.step(x, gradient)
        np.maximum(x[:-1], 0, out=x[:-1])
    model = Model(made.spread_out(x[:-1]), float(x[-1]))
    # a document of many sentences gathers many small chances; the bias is set where both labels err alike
    logit = np.bincount(number, made.scores(x[:-1])[which], minlength=total)
    best = max(np.arange(-6, 2.01, 0.25), key=lambda d: _balance(logit + model.bias + d, doc, labels) - 1e-3 * abs(d))
    model.bias += float(best)
    return model


def _balance(z: np.ndarray, doc: np.ndarray, labels: np.ndarray) -> float:
    said = -np.expm1(-np.bincount(doc, softplus(z), minlength=len(labels))) >= 0.5
    return (said[labels > 0].mean() + 2 * (~said[labels <= 0]).mean()) / 3


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Learn from at most about sample_docs labelled documents of sample_chars characters, chosen by hash.

    Null ids, texts and labels give nothing to learn from. Empty texts count as texts without words, and long ones are learned from
    whole. Rows that repeat an id with the same text and label count once; if the labels differ, each counts. Without rows
    or with one label only, every text gets that label's verdict (none: the lowest). Other columns aren't read.
    """
    sample = labelled_sample(only(docs, doc_id=id_col, text=text_col), only(labels, doc_id=id_col, label=label_col), sample_docs, sample_chars)
    return fit(sample["text"].tolist(), sample["label"].to_numpy(dtype=float))


SCORES = "doc_id long, score double, sentences int, worst_first_word int, worst_words int, worst_score double, worst_text string"


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's chance of being toxic, and its most toxic sentence: where it begins in words, how long it is, its words.

    A sentence is cut after LONGEST words, if nothing ends it before; no word is left out, and of sentences that score alike the first is told.
    Texts without words (null, empty) score 0 and have no sentence. Repeated rows score alike, each
    in a row of its own. Null ids stay null. An empty table gives no rows. Other columns aren't read.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIM weights

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for rows, texts in text_slices(batches):
            which, bounds, words = words_of(texts)
            number, by_doc = sentence_numbers(which, bounds, words)
            z = np.bincount(number, word_scores(words, model.weights)[which], minlength=int(by_doc[-1])) + model.bias
            doc = np.repeat(np.arange(len(texts)), np.diff(by_doc))
            p = -np.expm1(-np.bincount(doc, softplus(z), minlength=len(texts)))
            starts = np.searchsorted(number, np.arange(len(z) + 1))
            at = np.lexsort((-np.arange(len(z)), z, doc))  # the last of a document is its worst; of equals the first sentence
            has = np.diff(by_doc) > 0
            worst = at[by_doc[1:][has] - 1]
            column = lambda values, kind: pa.array(_spread(has, values), kind)
            text = [" ".join(words[w] for w in which[starts[s] : starts[s + 1]]) if p[d] >= 0.5 else None for d, s in zip(np.flatnonzero(has), worst, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id").cast(pa.int64()), pa.array(np.clip(p, 0, 1)), pa.array(np.diff(by_doc), pa.int32()), column((starts[worst] - bounds[:-1][has]).tolist(), pa.int32()), column(np.diff(starts)[worst].tolist(), pa.int32()), column(sigmoid(z[worst]).tolist(), pa.float64()), column(text, pa.string())],
                names=[c.split()[0] for c in SCORES.split(", ")],
            )

    return only(docs, doc_id=id_col, text=text_col).mapInArrow(make, SCORES)


def _spread(has: np.ndarray, values: list) -> list:
    it = iter(values)
    return [next(it) if h else None for h in has]
