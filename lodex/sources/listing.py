"""Listing trees and reading their files on the executors.

Folders yet to be listed are rows. In rounds, each task lists its folders and those below them, until it has seen so many entries;
the folders that it hasn't come to go to the next round, dealt over all tasks. So a small tree takes one round, a large one
a few more, and the driver neither lists a folder nor holds a path.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodex.config import MOST_BYTES
from lodex.sources.staging import drop, stage

#: Entries that a task sees in a round before it leaves the rest to others, bytes that a task reads, and that it holds at once.
ENTRIES, TASK_BYTES, HELD_BYTES = 5000, 64 << 20, 16 << 20
LISTED = "path string, size long, mtime timestamp, folder boolean"
FILE = "path string, size long, mtime timestamp, content binary"
_listed, _file = ([c.split()[0] for c in x.split(", ")] for x in (LISTED, FILE))

Keeps = Callable[[str, bool], bool]


def opened(root: str):
    """The file system of a root and the root's place in it. Any process of the cluster can open it; an OSError or ValueError says that Python can't."""
    from pyarrow import fs

    if root.startswith("file:"):
        root = "/" + root.removeprefix("file:").lstrip("/")
    if "://" in root:
        system, place = fs.FileSystem.from_uri(root)
        return system, place.rstrip("/")
    return fs.LocalFileSystem(), root.rstrip("/")


def readable(root: str) -> bool:
    try:
        opened(root)
    except (OSError, ValueError, ImportError):
        return False
    return True


def _time(info) -> pd.Timestamp:
    """To the thousandth of a second, as Spark's own reader has it."""
    return pd.Timestamp((info.mtime_ns or 0) // 10**6, unit="ms")


def _lister(root: str, keeps: Keeps, most: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, place = opened(root)
        seen = 0
        for pdf in batches:
            open_, out = pdf["path"].tolist(), []
            while open_ and seen < most:
                above = open_.pop()
                for info in system.get_file_info(fs.FileSelector(f"{place}/{above}".rstrip("/"), allow_not_found=True)):
                    seen += 1
                    name = f"{above}/{info.base_name}" if above else info.base_name
                    if info.type == fs.FileType.Directory:
                        if keeps(name, True):
                            open_.append(name)
                    elif info.type == fs.FileType.File and info.size <= MOST_BYTES and keeps(name, False):
                        out.append((name, info.size, _time(info), False))
            out += [(name, None, None, True) for name in open_]
            yield pd.DataFrame(out, columns=_listed)

    return run


def listing(spark: SparkSession, root: str, keeps: Keeps, entries: int = ENTRIES) -> DataFrame:
    """path, size, mtime of the files below the root that keeps takes and that aren't too large. Folders that it doesn't take are never entered.

    A table at rest. A folder that goes meanwhile has no files.
    """
    rounds, frontier, width = [], spark.createDataFrame([("",)], "path string"), 1
    while True:
        now = stage(frontier.repartition(width).mapInPandas(_lister(root, keeps, entries), LISTED), "listed")
        rounds.append(now)
        frontier = now.where("folder").select("path")
        left = frontier.count()
        if not left:
            break
        width = min(left, 4 * spark.sparkContext.defaultParallelism)
    files = [r.where("not folder").select("path", "size", "mtime") for r in rounds]
    if len(files) == 1:
        return files[0]
    whole = stage(reduce(DataFrame.unionByName, files), "listing")
    drop(*rounds)
    return whole


def listed(paths: DataFrame, root: str, keeps: Keeps) -> DataFrame:
    """The same of the named paths alone: each is asked for, and no folder is listed. Those that aren't there, or that a listing wouldn't come to, give no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, place = opened(root)
        for pdf in batches:
            names = [p for p in pdf["path"] if keeps(p, False) and all(keeps(p[:k], True) for k, c in enumerate(p) if c == "/")]
            found = system.get_file_info([f"{place}/{p}" for p in names]) if names else []
            yield pd.DataFrame([(p, i.size, _time(i)) for p, i in zip(names, found, strict=True) if i.type == fs.FileType.File and i.size <= MOST_BYTES], columns=_listed[:3])

    return paths.select("path").distinct().mapInPandas(run, LISTED.rpartition(",")[0])


def contents(files: DataFrame, root: str) -> DataFrame:
    """path, size, mtime, content of listed files, in tasks of about TASK_BYTES. A file that went meanwhile gives no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, place = opened(root)
        for pdf in batches:
            out, held = [], 0
            for row in pdf.itertuples(index=False):
                try:
                    with system.open_input_stream(f"{place}/{row.path}") as stream:
                        content = stream.read()
                except FileNotFoundError:
                    continue
                out.append((row.path, row.size, row.mtime, content))
                held += len(content)
                if held > HELD_BYTES:
                    yield pd.DataFrame(out, columns=_file)
                    out, held = [], 0
            yield pd.DataFrame(out, columns=_file)

    many, size = files.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    tasks = max(1, min(many, max(files.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))))
    # a number of its own, as the paths alone are small and would be put together again
    return files.repartition(tasks).mapInPandas(run, FILE)
