import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodex.streaming.timers import Deadlines, flush_order, next_tick


class Handle:
    """State and timers of one key, as a stream would keep them."""

    def __init__(self):
        self.value, self.timers = None, set()

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = tuple(value)

    def clear(self):
        self.value = None

    def registerTimer(self, ms):  # noqa: N802
        self.timers.add(ms)

    def deleteTimer(self, ms):  # noqa: N802
        self.timers.discard(ms)


class Info:
    def __init__(self, ms):
        self.ms = ms

    def getExpiryTimeInMs(self):  # noqa: N802
        return self.ms


def plain(events, quiet, tick):
    """What goes out by going through all events in order."""
    out, held = [], None
    for op, ms in events:
        if held and held[1] <= ms:
            out.append(held)
            held = None
        held = (op, next_tick(ms, tick) if op == "delete" else ms + quiet, (held[2] if held else 0) + 1)
    return [*out, held] if held else out


@pytest.mark.parametrize("seed", range(20))
def test_operations_wait_and_replace_each_other(seed):
    """However events are split into batches and whenever timers come, the same operations go out, and one timer is set at most."""
    rng = random.Random(seed)
    times = sorted(rng.randrange(5000) for _ in range(30))
    events = [(rng.choice(["change", "change", "delete"]), ms) for ms in times]
    state, handle, out = Deadlines(400, 100), Handle(), []
    state.init(handle)

    def take(frames):
        for pdf in frames:
            out.extend((r.op, int(r.due.value // 10**6), r.events) for r in pdf.itertuples())

    k = 0
    while k < len(events):
        n = rng.randrange(1, 6)
        part = pd.DataFrame([(op, ms, k + j) for j, (op, ms) in enumerate(events[k : k + n])], columns=["op", "ms", "seq"])
        take(state.handleInputRows(("p",), iter([part.sample(frac=1, random_state=seed)]), None))
        k += n
        assert len(handle.timers) <= 1
        reached = events[k][1] if k < len(events) else 10**6
        for ms in sorted(t for t in handle.timers if t <= reached):
            if rng.random() < 0.7 or k >= len(events):  # a stream may see the next events first
                handle.timers.discard(ms)
                take(state.handleExpiredTimer(("p",), None, Info(ms)))
    assert out == plain(events, 400, 100)
    state.close()


def test_deletes_go_first_and_batches_are_bounded(spark):
    rows = [(f"p{k:03}", "change", 1000 + k % 7) for k in range(150)] + [("gone", "delete", 1050), ("late", "change", 1101)]
    flushed = spark.createDataFrame(rows, "path string, op string, ms long").select("path", "op", F.timestamp_millis("ms").alias("due"))
    got = {r.path: (r.tick, r.nth) for r in flush_order(flushed).collect()}
    assert got["gone"] == (11, 0) and got["late"] == (12, 1)
    sizes = [sum(v == (tick, nth) for v in got.values()) for tick in (10, 11) for nth in (1, 2, 3)]
    assert max(sizes) <= 64 and sum(sizes) == 150


def test_a_path_without_operations_makes_no_frame():
    """Frames are what takes time where paths are many: none is made for a path of which nothing goes out."""
    state, handle = Deadlines(400, 100), Handle()
    state.init(handle)
    assert not list(state.handleInputRows(("p",), iter([pd.DataFrame([("change", 10, 1)], columns=["op", "ms", "seq"])]), None))
    assert not list(state.handleExpiredTimer(("p",), None, Info(409)))
    made = list(state.handleExpiredTimer(("p",), None, Info(410)))
    assert [(r.path, r.op, r.due, r.events) for pdf in made for r in pdf.itertuples()] == [("p", "change", pd.Timestamp(410, unit="ms"), 1)]
    assert made[0]["due"].dtype == "datetime64[ns]"
