"""An index of the three-byte runs of files, and those that a regular expression can't do without.

A line that a pattern matches holds the pattern's literal runs, so a file without their three-byte runs needn't be read. Letters of ASCII count
as small ones. What a pattern needs follows from its syntax; one that needs nothing of three bytes has every file read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product
from re import _constants as op
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodex.operators.retrieval import raw_search

#: Alternatives and spellings of a run that are told apart; beyond them a part of the pattern isn't used.
ALTERNATIVES, SPELLINGS = 64, 16
_LOWER = bytes(k + 32 if 65 <= k <= 90 else k for k in range(256))
GRAMS = "path string, gram int"
#: Runs that a task makes before it hands them on.
RUNS = 1 << 17

Needs = list[frozenset[int]]


def codes(data: bytes) -> np.ndarray:
    """The different three-byte runs that lie within a line, as numbers."""
    x = np.frombuffer(data.translate(_LOWER), dtype=np.uint8).astype(np.int32)
    if len(x) < 3:
        return np.zeros(0, dtype=np.int32)
    made = (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]
    return np.unique(made[(x[:-2] != 10) & (x[1:-1] != 10) & (x[2:] != 10)])


def grams(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, gram: the index. In order of gram, a search reads the row groups of its runs only."""

    def made(names: list[str], found: list[np.ndarray]) -> pa.RecordBatch:
        of = pa.array(np.repeat(np.arange(len(names)), [len(x) for x in found]))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(of), pa.array(np.concatenate(found))], ["path", "gram"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, found, n = [], [], 0
        for batch in batches:
            for p, t in zip(*batch.columns, strict=True):
                names.append(p.as_py())
                found.append(codes((t.as_py() or "").encode("utf-8", "surrogatepass")))
                n += len(found[-1])
                if n >= RUNS:  # many files' runs are a batch
                    yield made(names, found)
                    names, found, n = [], [], 0
        if names:
            yield made(names, found)

    return files.select(files[path].alias("path"), files[text].alias("text")).mapInArrow(run, GRAMS)


def _both(a: Needs, b: Needs) -> Needs:
    """What a match needs that needs one of a and one of b. Of too many alternatives one side is used."""
    if len(a) * len(b) > ALTERNATIVES:
        return min(a, b, key=len)
    return list({x | y for x, y in product(a, b)})


def _of_run(spellings: set[str]) -> Needs:
    return list({frozenset(codes(s.encode("utf-8", "surrogatepass")).tolist()) for s in spellings})


def _spelled(items) -> set[str] | None:
    """All texts that a part of a pattern stands for, if these are few."""
    out = {""}
    for kind, value in items:
        if kind is op.LITERAL:
            more = {chr(value)}
        elif kind is op.IN and all(k is op.LITERAL for k, _ in value) and len(value) <= 4:
            more = {chr(v) for _, v in value}
        elif kind is op.SUBPATTERN:
            more = _spelled(value[3])
        elif kind is op.BRANCH:
            parts = [_spelled(b) for b in value[1]]
            more = set().union(*parts) if all(p is not None for p in parts) else None
        elif kind is op.AT:
            more = {""}
        else:
            more = None
        if more is None or len(out) * len(more) > SPELLINGS:
            return None
        out = {a + b for a, b in product(out, more)}
    return out


def _needs(items) -> Needs:
    total: Needs = [frozenset()]
    run = {""}
    for item in items:
        kind, value = item
        more = _spelled([item])
        if more is not None and len(run) * len(more) <= SPELLINGS:
            run = {a + b for a, b in product(run, more)}
            continue
        total, run = _both(total, _of_run(run)), {""}
        if more is not None:
            run = more
        elif kind is op.SUBPATTERN:
            total = _both(total, _needs(value[3]))
        elif kind is op.BRANCH:
            parts = [n for b in value[1] for n in _needs(b)]
            total = _both(total, list(set(parts))) if len(set(parts)) <= ALTERNATIVES else total
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and value[0] >= 1:
            total = _both(total, _needs(value[2]))
        elif kind is op.ATOMIC_GROUP:
            total = _both(total, _needs(value))
    return _both(total, _of_run(run))


def needed(pattern: str) -> Needs | None:
    """Alternatives of runs, of one of which a matching line holds all; None if that is no help."""
    tree = _parser.parse(pattern)
    if tree.state.flags & (re.VERBOSE | re.LOCALE):
        return None
    found = _needs(tree)
    return None if any(not n for n in found) else found


def candidates(index: DataFrame, needs: Needs) -> DataFrame:
    """path: files that hold all runs of an alternative."""
    wanted = [(k, g, len(n)) for k, n in enumerate(needs) for g in sorted(n)]
    asked = index.sparkSession.createDataFrame(wanted, "alternative int, gram int, need int")  # as many as the pattern has letters
    some = index.where(F.col("gram").isin(*{g for _, g, _ in wanted})).join(F.broadcast(asked), "gram")
    return some.groupBy("path", "alternative", "need").agg(F.count_distinct("gram").alias("n")).where("n = need").select("path").distinct()


def indexed_search(files: DataFrame, index: DataFrame, pattern: str, first_only: bool = True, path: str = "path", text: str = "text") -> DataFrame:
    """What raw_search finds, by reading the files that may match only."""
    try:
        needs = needed(pattern)
    except (re.error, RecursionError):  # raw_search says what is wrong with it
        needs = None
    some = files if needs is None else files.join(candidates(index, needs).withColumnRenamed("path", path), path, "left_semi")
    return raw_search(some, pattern, first_only, path, text)
