"""Distances, cuts and stand-in embeddings."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodex.config import CLIP, DIMENSIONS


def squared_l2(a: Column, b: Column) -> Column:
    """In double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def truncated(v: Column, dims: int) -> Column:
    """The first components, brought to unit length; the zero vector stays."""
    cut = F.transform(F.slice(v, 1, dims), lambda x: x.cast("double"))
    norm = F.sqrt(dot(cut, cut))
    return F.transform(cut, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


def literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def hash_embedding(text: str, dims: int = DIMENSIONS) -> np.ndarray:
    """Signed hashed words and character trigrams, of unit length: a stand-in for a model."""
    out = np.zeros(dims)
    words = re.findall(r"\w+", text[:CLIP].lower())
    for token in [*words, *(w[k : k + 3] for w in words for k in range(len(w) - 2))]:
        h = int.from_bytes(hashlib.md5(token.encode()).digest()[:8], "little")
        out[h % dims] += 1 if h >> 63 else -1
    norm = np.linalg.norm(out)
    return out / (norm or 1)


def unit(vector: Sequence[float], dims: int) -> np.ndarray:
    """The first components, of unit length; the zero vector stays."""
    v = np.asarray(vector, dtype=float)[:dims]
    return v / (np.linalg.norm(v) or 1)


def embedder(encode: Callable[[str], np.ndarray] = hash_embedding, dims: int = DIMENSIONS):
    """A Pandas UDF that makes unit vectors of a column of texts, of a model's first components; the zero vector stays."""

    def cut(text: str) -> list[float]:
        return unit(encode(text[:CLIP]), dims).astype(np.float32).tolist()

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.fillna("").map(cut)

    return embed
