"""What the operators share: staged tables, Arrow slices, and words of a column of texts."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodex.sources.staging import drop as drop
from lodex.sources.staging import shared_folder as shared_folder
from lodex.sources.staging import stage as stage

#: Bytes of text that a worker holds at once, apart from a single longer text.
SLICE_BYTES = 8 << 20
#: Rows of one Arrow batch; texts are long, so the default of 10,000 rows would need much memory.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches of long texts small. This changes the session's setting for good; a lower one stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Just the named columns under the operator's own names, so others can't clash."""
    return df.select(*[df[f"`{source}`"].alias(name) for name, source in columns.items()])


def with_rows(df: DataFrame, row_col: str | None, **columns: str) -> DataFrame:
    """The named columns, and `row`, which tells rows alike apart: the given column, or a number of each row."""
    if row_col is not None:
        return only(df, **columns, row=row_col)
    return only(df, **columns).withColumn("row", F.monotonically_increasing_id())


#: Files whose numbers are broadcast, a path each; and rows of a file.
MOST_FILES, FILE_ROWS = 100_000, 1 << 40


def numbered(docs: DataFrame, row_col: str) -> DataFrame:
    """docs with a number of each row that is the same at every scan, however the scan is split, so rows alike can be told apart.

    Rows of Parquet files go by their file and their place in it; the files, at most MOST_FILES paths, are numbered by name.
    Other DataFrames, and those of more files, are written once with numbers, and that table is returned.
    """
    spark = docs.sparkSession
    try:
        placed = docs.select(*[docs[f"`{c}`"] for c in docs.columns], F.col("_metadata.file_path").alias("lodex_file"), F.col("_metadata.row_index").alias("lodex_index"))
        names = [r[0] for r in placed.select("lodex_file").distinct().limit(MOST_FILES + 1).collect()]
    except AnalysisException:  # not of files, or of others than Parquet
        names = []
    if not 0 < len(names) <= MOST_FILES:
        return stage(docs.withColumn(row_col, F.monotonically_increasing_id()), "numbered")
    files = spark.createDataFrame([(name, k * FILE_ROWS) for k, name in enumerate(sorted(names))], "lodex_file string, lodex_first long")
    return placed.join(F.broadcast(files), "lodex_file").withColumn(row_col, F.col("lodex_first") + F.col("lodex_index")).drop("lodex_file", "lodex_index", "lodex_first")


def join_hot(rows: DataFrame, facts: DataFrame, key: str, size: str, total: int, large: int = 1000) -> DataFrame:
    """rows with the facts of their key. facts: one row for each key, with the number of its rows under size; total: rows in all.

    Keys of over a thousandth of the rows, which are at most a thousand, come by broadcast, so a key's rows never need to
    meet in one task. Both tables are at rest, as they are read twice.
    """
    hot = F.broadcast(facts.where(F.col(size) > F.lit(total // large)))
    rest = rows.join(hot.select(key), key, "left_anti").join(facts, key)
    return rest.unionByName(rows.join(hot, key))


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """(rows, their texts as binary without nulls) of at most SLICE_BYTES, or of one longer text."""
    for batch in batches:
        texts = batch.column(column)
        sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
        begin, held = 0, 0
        for k, n in enumerate(sizes):
            if held and held + n > SLICE_BYTES:
                yield batch.slice(begin, k - begin), _binary(texts.slice(begin, k - begin))
                begin, held = k, 0
            held += int(n)
        if begin < len(sizes):
            yield batch.slice(begin), _binary(texts.slice(begin))


def _binary(texts: pa.Array) -> pa.Array:
    return pc.fill_null(pc.cast(texts, pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()), b"")


def text_bytes(texts: pa.Array) -> Iterator[bytes]:
    """Each text's bytes, made one by one."""
    for value in texts:
        yield value.as_py()


def words_of(texts: pa.Array, as_bytes: bool = False) -> tuple[np.ndarray, np.ndarray, list]:
    """Runs of characters other than space and \\x09-\\x0D, of all texts of a slice.

    Returns each word's number in the list of different words, the words' bounds by text, and the list.
    """
    kind = pa.large_string() if pa.types.is_large_binary(texts.type) else pa.string()
    parts = pc.ascii_split_whitespace(pc.cast(texts, kind, safe=False))
    offsets = np.asarray(parts.offsets, dtype=np.int64)
    flat = parts.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    coded = flat.dictionary_encode()
    which = np.asarray(coded.indices, dtype=np.int64)
    names = (pc.cast(coded.dictionary, pa.large_binary() if pa.types.is_large_string(coded.dictionary.type) else pa.binary()) if as_bytes else coded.dictionary).to_pylist()
    nothing = b"" if as_bytes else ""
    empty = names.index(nothing) if nothing in names else -1
    if empty >= 0:
        full = which != empty
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
        which = which[full]
        which -= which > empty
        del names[empty]
    return which, offsets, names


def sums_by_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values between each two offsets; of nothing: 0."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


class WordCache:
    """Rows of numbers by word, made by make(words) when first asked; holds so many words at most."""

    def __init__(self, make: Callable[[list[str]], np.ndarray], width: int, room: int = 200_000):
        self.make, self.room, self.at = make, room, {}
        self.rows = np.zeros((1024, width), dtype=np.float32)

    def __call__(self, words: list[str]) -> np.ndarray:
        found = np.fromiter((self.at.get(w, -1) for w in words), dtype=np.int64, count=len(words))
        out = np.zeros((len(words), self.rows.shape[1]), dtype=np.float32)
        out[found >= 0] = self.rows[found[found >= 0]]
        missing = np.flatnonzero(found < 0)
        if len(missing):
            out[missing] = self.make([words[k] for k in missing])
            keep = missing[: max(0, self.room - len(self.at))]
            first = len(self.at)
            while first + len(keep) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[first : first + len(keep)] = out[keep]
            self.at.update((words[k], first + j) for j, k in enumerate(keep))
        return out


#: Caches of this Python worker by model, so that a worker that runs many tasks makes each word's rows once.
_caches: dict[str, WordCache] = {}


def cache_for(key: str, make: Callable[[list[str]], np.ndarray], width: int) -> WordCache:
    """This worker's cache of the model named key; others go, so only one is held."""
    if key not in _caches:
        _caches.clear()
        _caches[key] = WordCache(make, width)
    return _caches[key]


def share_below(column: str, share: float):
    """True for about this share of the rows, chosen by the value's hash alone."""
    return F.pmod(F.xxhash64(F.col(column).cast("string"), F.lit("sample")), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))


def give_back() -> None:
    """Return freed memory to the system, so a driver that has learned from a sample doesn't go on holding it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every system has it
        ctypes.CDLL(None).malloc_trim(0)


def crc_remainder(column: str, modulus: int):
    """crc32 of the value as text, modulo."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def crc(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))
