"""Scanning trees, and marks of what they hold."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodex.config import EXTENSIONS, MOST_BYTES, EngineConfig
from lodex.functions.paths import language, path_test
from lodex.functions.text import line_count
from lodex.sources.listing import Keeps, contents, listed, listing, readable
from lodex.sources.store import Store as Store


#: Signs that a path to load may not have unmarked.
_GLOB = re.compile(r"([\\\[\]{}*?])")


def wanted(spark: SparkSession, config: EngineConfig) -> Keeps:
    """Which paths a scan takes, and which folders it enters, by the settings and the root's ignore files."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(config.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return path_test(extensions=(*EXTENSIONS, *config.extra_extensions), exclude=config.exclude, ignore_lines=(*_ignore_lines(spark, config, fs, path), *config.ignore_lines), substring=config.compat_substring)


def walk(spark: SparkSession, config: EngineConfig) -> list[tuple[str, int, int]]:
    """(path, size, milliseconds) below the root of the files that a scan takes, listed by the driver: for stores of files that only Hadoop opens."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = path(config.root)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    keeps = wanted(spark, config)
    found, open_ = [], [("", root)]
    while open_:
        above, folder = open_.pop()
        for status in fs.listStatus(folder):
            name = above + status.getPath().getName()
            if status.isDirectory():
                if keeps(name, True):
                    open_.append((f"{name}/", status.getPath()))
            elif status.getLen() <= MOST_BYTES and keeps(name, False):
                found.append((name, status.getLen(), status.getModificationTime()))
    return sorted(found)


def _ignore_lines(spark: SparkSession, config: EngineConfig, fs, path) -> list[str]:
    """Lines of the root's own ignore files, in order."""
    out: list[str] = []
    for name in config.ignore_files:
        place = f"{config.root.rstrip('/')}/{name}"
        if fs.exists(path(place)):
            stream = fs.open(path(place))  # Spark's readers pass over names that begin with a dot
            out += spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
            stream.close()
    return out


def tree(spark: SparkSession, config: EngineConfig, only: DataFrame | None = None) -> DataFrame:
    """path, size, mtime of the wanted files below the root, or of those of them that `only` (path) names; no content is read."""
    if readable(config.root):
        keeps = wanted(spark, config)
        found = listing(spark, config.root, keeps) if only is None else listed(only, config.root, keeps)
    else:
        found = spark.createDataFrame(walk(spark, config), "path string, size long, ms long").select("path", "size", F.timestamp_millis("ms").alias("mtime"))
        found = found if only is None else found.join(only.select("path"), "path", "left_semi")
    return found.where(language(F.col("path")).isin(*config.languages)) if config.languages else found


def read(spark: SparkSession, config: EngineConfig, found: DataFrame) -> DataFrame:
    """path, size, mtime, content_hash, language, line_count, text of listed files."""
    raw = contents(found, config.root) if readable(config.root) else _by_spark(spark, config, found)
    text = F.decode(F.col("content"), "UTF-8")
    return raw.select("path", "size", "mtime", F.sha2("content", 256).alias("content_hash"), language(F.col("path")).alias("language"), line_count(text).alias("line_count"), text.alias("text"))


def scan(spark: SparkSession, config: EngineConfig, only: Iterable[str] | DataFrame | None = None) -> DataFrame:
    """The wanted files below the root, or those of them named in only, as read gives them. Only files that pass the filter on paths and sizes are read."""
    if only is not None and not isinstance(only, DataFrame):
        only = spark.createDataFrame([(p,) for p in only], "path string")
    return read(spark, config, tree(spark, config, only))


def _by_spark(spark: SparkSession, config: EngineConfig, found: DataFrame) -> DataFrame:
    """path, size, mtime, content by Spark's own reader, which is handed each path."""
    root = config.root.rstrip("/")
    places = [_GLOB.sub(r"\\\1", f"{root}/{r.path}") for r in found.select("path").toLocalIterator()]
    raw = spark.read.format("binaryFile").load(places) if places else spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
    below = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    rel = F.substring("path", F.instr("path", f"{below}/") + len(below) + 1, F.lit(1 << 30))
    return raw.select(rel.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")


def env_pairs(lines: DataFrame, column: str = "value") -> DataFrame:
    """key, val of KEY=VALUE lines; blanks and comments are skipped, the first = splits."""
    line = F.trim(F.col(column))
    return lines.where((line != "") & ~line.startswith("#") & line.contains("=")).select(F.trim(F.split_part(line, F.lit("="), F.lit(1))).alias("key"), F.trim(F.expr(f"substring(trim({column}), instr(trim({column}), '=') + 1)")).alias("val"))


def mark_sums(files: DataFrame, *columns: str) -> DataFrame:
    """One row of strings: the number of files, and the sums of four quarters of their hashes. Sums have no order, so each task adds up its own, and changes can be added and taken away."""
    h = F.sha2(F.concat_ws("\x1f", *columns), 256)
    quarters = [F.conv(F.substring(h, 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)") for k in range(4)]
    sums = [F.coalesce(F.sum(q.cast("decimal(28,0)")), F.lit(0)).cast("string") for q in quarters]
    return files.agg(F.count("*").cast("string").alias("n"), *[s.alias(f"s{k}") for k, s in enumerate(sums)])


def fingerprint(files: DataFrame, *columns: str) -> DataFrame:
    """One row: a hash over the sums."""
    return mark_sums(files, *columns).select(F.sha2(F.concat_ws(",", "n", "s0", "s1", "s2", "s3"), 256).alias("fingerprint"))


def mark_of(sums: Iterable[str | int]) -> str:
    """The fingerprint of given sums."""
    return hashlib.sha256(",".join(map(str, sums)).encode()).hexdigest()
