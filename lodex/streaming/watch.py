"""File events to table changes: debounce by session windows, apply by micro-batches."""

from __future__ import annotations

import logging
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodex.config import DEBOUNCE_MS, FLUSH_PATHS
from lodex.operators.freshness import last_op
from lodex.sources.staging import drop, stage


def normalised_events(raw: DataFrame) -> DataFrame:
    """path, op (change or delete), ts, seq of raw events (kind, path, dest, ts, seq): a move deletes one path and changes another; folders don't count."""
    kind = F.col("kind")
    ops = F.when(kind == "moved", F.array(F.struct(F.lit("delete").alias("op"), F.col("path").alias("p")), F.struct(F.lit("change").alias("op"), F.col("dest").alias("p")))).otherwise(F.array(F.struct(F.when(kind == "deleted", "delete").otherwise("change").alias("op"), F.col("path").alias("p"))))
    return raw.where(~F.coalesce("is_dir", F.lit(False))).select(F.explode(ops).alias("o"), "ts", "seq").select(F.col("o.p").alias("path"), F.col("o.op").alias("op"), "ts", "seq")


def debounced(events: DataFrame, gap: str = f"{DEBOUNCE_MS} milliseconds", late: str | None = None) -> DataFrame:
    """Bursts of a path as one operation, the last. late: how long a stream waits for late events; later ones are dropped."""
    return last_op(events.withWatermark("ts", late) if late else events, gap)


def flush_batches(pending: DataFrame, size: int = FLUSH_PATHS) -> DataFrame:
    """tick: the batch, of so many paths, in which a pending path is flushed, by path within its deadline's tick."""
    from pyspark.sql import Window

    return pending.withColumn("tick", F.floor((F.row_number().over(Window.partitionBy("due").orderBy("path")) - 1) / size))


def apply_to(events: DataFrame, delete: Callable[[DataFrame], None], change: Callable[[DataFrame], None], checkpoint: str, **options: str) -> StreamingQuery:
    """Run deletes, then changes, of each micro-batch; of several operations on a path in it the last counts."""

    def batch(df: DataFrame, _: int) -> None:
        last = df.groupBy("path").agg(F.max_by("op", "begin").alias("op")).persist()
        try:
            delete(last.where("op = 'delete'").select("path"))
            change(last.where("op = 'change'").select("path"))
        finally:
            last.unpersist()

    return events.writeStream.option("checkpointLocation", checkpoint).options(**options).trigger(availableNow=True).foreachBatch(batch).start()


def keep_fresh(events: DataFrame, engine, folder: str, checkpoint: str, **options: str) -> tuple[StreamingQuery, Callable]:
    """Apply events (path, op, begin) to an engine's tree and store: a micro-batch is one delta, in which deletes and changes count together; one that fails is done again from its checkpoint.

    Returns the stream and a function that gives the engine as it is now. Paths stay on the executors, and a batch is as large as the source's options let it be.
    """
    held = [engine]

    def batch(df: DataFrame, _: int) -> None:
        last = stage(df.groupBy("path").agg(F.max_by("op", "begin").alias("op")), "events")
        if not last.isEmpty():
            held[0] = held[0].applied(last.where("op <> 'delete'"), last.where("op = 'delete'"), folder)
        drop(last)

    query = events.writeStream.option("checkpointLocation", checkpoint).options(**options).trigger(availableNow=True).foreachBatch(batch).start()
    return query, lambda: held[0]


def flush(query: StreamingQuery, seconds: float = 1.0) -> bool:
    """Have what has come applied before a read, waiting for so long at most. False: there is more to apply."""
    worker = threading.Thread(target=query.processAllAvailable, daemon=True)
    worker.start()
    worker.join(seconds)
    return not worker.is_alive()


def poll(mark: Callable[[], str], act: Callable[[], None], stop: threading.Event, every: float = 2.0, quiet: float = 1.0, pause: float = 5.0) -> None:
    """Act whenever a snapshot's mark changes and then stays for a while; until stopped. If acting fails, it is tried again after a pause."""
    known = mark()
    while not stop.wait(every):
        now = mark()
        if now == known:
            continue
        while not stop.wait(quiet) and (later := mark()) != now:
            now = later
        if stop.is_set():
            return
        try:
            act()
            known = now
        except Exception:
            logging.getLogger(__name__).exception("acting on a change failed")
            stop.wait(pause)
