"""Pending operations of each path as keyed state with timers.

A change waits until its path has been quiet for a while: each event pushes its deadline. A delete isn't held back, it goes at the next
tick. A change takes the place of a pending delete and the other way round, so a path has one pending operation at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodex.config import DEBOUNCE_MS, FLUSH_PATHS, TICK_MS

FLUSHED = "path string, op string, due timestamp, events long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def next_tick(ms: int, tick: int) -> int:
    """The first tick after a time."""
    return (ms // tick + 1) * tick


class Deadlines(StatefulProcessor):
    """The operation of a path that is pending, its deadline, and how many events it stands for."""

    def __init__(self, quiet: int, tick: int):
        self.quiet, self.tick = quiet, tick

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "op string, due long, at long, seq long, events long")

    def _rows(self, key: tuple, out: list[tuple[str, int, int]]) -> Iterator[pd.DataFrame]:
        """A frame of operations (op, due, events), none if there are none: a path has few events, so frames are what takes time."""
        if out:
            ops, due, events = zip(*out, strict=True)
            yield pd.DataFrame({"path": [key[0]] * len(out), "op": ops, "due": np.array(due, "datetime64[ms]").astype("datetime64[ns]"), "events": events})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = sorted((e for part in rows for e in zip(part["ms"].tolist(), part["seq"].tolist(), part["op"].tolist(), strict=True)), key=itemgetter(0, 1))
        held, out = self.pending.get() if self.pending.exists() else None, []
        timer = held[1] if held else None
        for ms, seq, op in events:
            if held and (ms, seq) < (held[2], held[3]):
                continue  # what came later is known already
            if held and held[1] <= ms:
                out.append((held[0], held[1], held[4]))
                held = None
            due = next_tick(ms, self.tick) if op == "delete" else ms + self.quiet
            held = (op, due, ms, seq, (held[4] if held else 0) + 1)
        if held and held[1] != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(held[1])
            timer = held[1]
        if held:
            self.pending.update(held)
        yield from self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.pending.get() if self.pending.exists() else None
        if held and held[1] <= expiredTimerInfo.getExpiryTimeInMs():
            self.pending.clear()
            yield from self._rows(key, [(held[0], held[1], held[4])])

    def close(self) -> None:
        pass


def pending_flushes(events: DataFrame, quiet_ms: int = DEBOUNCE_MS, tick_ms: int = TICK_MS, late: str = "1 second") -> DataFrame:
    """path, op, due, events of a stream of events (path, op, ts, seq): each operation when its deadline has passed.

    late: how long the stream waits for events that come out of order. Sessions that run it keep state in RocksDB (PROVIDER).
    """
    timed = events.withWatermark("ts", late).select("path", "op", "ts", "seq", F.unix_millis("ts").alias("ms"))
    return timed.groupBy("path").transformWithStateInPandas(Deadlines(quiet_ms, tick_ms), FLUSHED, "Append", "EventTime")


def tick_of(due: Column, tick_ms: int = TICK_MS) -> Column:
    """Number of the tick at which a deadline is seen."""
    return F.ceil(F.unix_millis(due) / tick_ms)


def flush_order(flushed: DataFrame, size: int = FLUSH_PATHS, tick_ms: int = TICK_MS) -> DataFrame:
    """With tick, and nth: the batch within it. Deletes are batch 0, changes follow, so many paths in each, in order of deadline and path.

    Ranks are made within a tick, which holds what fell due within a tenth of a second.
    """
    ticked = flushed.withColumn("tick", tick_of(F.col("due"), tick_ms))
    rank = F.row_number().over(Window.partitionBy("tick", F.col("op") == "delete").orderBy("due", "path")) - 1
    return ticked.withColumn("nth", F.when(F.col("op") == "delete", F.lit(0)).otherwise(1 + F.floor(rank / size)).cast("int"))
