"""Repair of the structure of conversations by A* on the lattice of edits.

A conversation's turns are kept, given another role or deleted, and turns may be put in between, so that the roles are an optional
system turn and then pairs of user and assistant. A node of the lattice is a number of turns done and the role that came last.
What is ahead costs at least a deletion for each turn that has to go and a charge for each truncated one; with these sums the
search looks at (cost so far plus these, edits so far) in order, so it ends at the cheapest repair, of several the first by its edits.

Turns are sorted over all tasks and cut into segments of bounded size. Most conversations are one segment. Those that begin or
end a task's share or are longer are chains: each of their segments is searched from every role to every role, and a
conversation's segments are joined in order by these results alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodex.llm.support import drop, numbered, only, small_batches, stage

#: Turns and bytes of text of a segment, apart from a single longer text.
TURNS, BYTES = 1000, 4 << 20
RETYPE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: What came last: nothing, or a turn of the system, the user or the assistant; which role may come next, and what then came last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {NOTHING: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: The role that a new or retyped turn can have after each.
MADE = {NOTHING: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
ROLES = {"u": "user", "a": "assistant"}
#: Where a conversation may end.
ENDS = (NOTHING, ASSISTANT)
#: A turn that has to go. Others are the first letter of their role, x if that is none of the three; a capital if truncated.
GONE = "D"
WHITE = " \t\n\v\f\r"


@lru_cache(maxsize=50_000)
def search(turns: str, after: int, last: bool) -> dict[int, tuple[int, str]]:
    """The cheapest edits of these turns by what came last when they are done: (cost, edits), where turns are put in before others only.

    last: these end the conversation; then one place where it may end, with turns put in behind as well.
    """
    ahead = [0]
    for t in reversed(turns):
        ahead.append(ahead[-1] + (DELETE if t == GONE else TRUNCATED if t.isupper() else 0))
    ahead.reverse()
    open_, settled, found = [(ahead[0], "", 0, after)], set(), {}
    while open_ and len(found) < (1 if last else 4):
        least, edits, done, came = heappop(open_)
        if (done, came) in settled:
            continue
        settled.add((done, came))
        cost = least - ahead[done]
        if done == len(turns):
            if not last or came in ENDS:
                found[came] = cost, edits
            if not last:
                continue
        made = NEXT[came][MADE[came]]
        heappush(open_, (cost + INSERT + ahead[done], edits + "I", done, made))
        if done == len(turns):
            continue
        turn, rest = turns[done], ahead[done + 1]
        heappush(open_, (cost + DELETE + rest, edits + "D", done + 1, came))
        if turn != GONE:
            charge = TRUNCATED if turn.isupper() else 0
            if turn.lower() in NEXT[came]:
                heappush(open_, (cost + charge + rest, edits + "K", done + 1, NEXT[came][turn.lower()]))
            heappush(open_, (cost + RETYPE + charge + rest, edits + "R", done + 1, made))
    return found


def repaired(turns: list[dict], edits: str, after: int) -> tuple[list[dict], int]:
    """The turns that are left after the edits, and what came last."""
    out, rest = [], iter(turns)
    for e in edits:
        turn = next(rest) if e != "I" else {"text": ""}
        if e != "D":
            first = turn["role"][:1] if e == "K" else MADE[after]
            out.append({"role": turn["role"] if e == "K" else ROLES[first], "text": turn["text"]})
            after = NEXT[after][first]
    return out, after


def codes(turns: list[dict], seen: set[int]) -> tuple[str, dict[str, int]]:
    """The turns as search takes them, and counts of faults; seen: numbers of those that came before with the same role and text."""
    out, counts = [], {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
    for k, t in enumerate(turns):
        text, first = t["text"].strip(WHITE), t["role"][:1]
        code = first if first in ("s", "u", "a") else "x"
        if not text or k in seen:
            counts["duplicate" if text else "blank"] += 1
            code = GONE
        elif text[-1] not in ".!?":
            counts["truncated"] += 1
            code = code.upper()
        out.append(code)
        counts["illegal"] += k > 0 and not legal(turns[k - 1]["role"][:1], first)
    return "".join(out), counts


def legal(one: str, other: str) -> bool:
    return one + other in ("su", "ua", "au")


TURN = "struct<turn: long, role: string, text: string, sha: string>"
SEGMENTS = f"conv_id long, part int, nth int, whole boolean, turns array<{TURN}>"
_turn = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("sha", pa.string())])


def segments(turns: DataFrame) -> DataFrame:
    """Rows sorted by conversation and place, cut; whole: that nothing of the conversation is anywhere else."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, held, size, now, alone, out = TaskContext.get().partitionId(), 0, [], 0, None, False, []

        def close(goes_on: bool) -> None:
            nonlocal nth, held, size
            if held:
                out.append((now, part, nth, alone and not goes_on, held))
                nth, held, size = nth + 1, [], 0

        def flushed() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(_turn)), strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SEGMENTS.split(", ")[:5]])

        for batch in batches:
            for row in batch.to_pylist():
                conv = row.pop("conv_id")
                if not nth and not held:
                    now, alone = conv, part == 0
                elif conv != now:
                    close(False)
                    now, alone = conv, True
                elif len(held) >= TURNS or size >= BYTES:
                    close(True)
                    alone = False
                held.append(row)
                size += len(row["text"])
            if out:
                yield flushed()
        close(True)
        if out:
            yield flushed()

    return turns.select("conv_id", "turn", "role", "text", "sha").mapInArrow(cut, SEGMENTS)


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
KEPT = "array<struct<role: string, text: string>>"
_kept = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
SUMMARY = ", ".join(f"{c} long" for c in COUNTS) + ", audit string"
WHOLE = f"conv_id long, part int, nth int, {SUMMARY}, turns {KEPT}"


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


_id = [("conv_id", pa.int64()), ("part", pa.int32()), ("nth", pa.int32())]
_summary = [*((c, pa.int64()) for c in COUNTS), ("audit", pa.string())]


def gaps(least: int | None, most: int | None, different: int) -> int:
    return 0 if least is None else most - least + 1 - different


def solve_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repairs of conversations of one segment."""
    schema = pa.schema([*_id, *_summary, ("turns", _kept)])
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            turns, seen, first = row["turns"], set(), {}
            for k, t in enumerate(turns):
                if first.setdefault(t["sha"], k) != k:
                    seen.add(k)
            code, counts = codes(turns, seen)
            [(cost, edits)] = search(code, NOTHING, True).values()
            numbers = {t["turn"] for t in turns} - {None}
            counts |= {"gaps": gaps(min(numbers, default=None), max(numbers, default=None), len(numbers)), "cost": cost, "audit": edits}
            out.append({k: row[k] for k in ("conv_id", "part", "nth")} | counts | {"turns": repaired(turns, edits, NOTHING)[0]})
        yield _batch(out, schema)


_path = pa.list_(pa.struct([("after", pa.int32()), ("came", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())]))
_edge = [("least", pa.int64()), ("most", pa.int64()), ("different", pa.int64()), ("first", pa.string()), ("final", pa.string())]
_faults = [(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")]
PATHS = "conv_id long, part int, nth int, least long, most long, different long, first string, final string, blank long, duplicate long, truncated long, illegal long, paths array<struct<after: int, came: int, cost: long, edits: string>>, ends array<struct<after: int, came: int, cost: long, edits: string>>"


def solve_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of chains: from each role to each, and, should the conversation end here, to its end."""
    schema = pa.schema([*_id, *_edge, *_faults, ("paths", _path), ("ends", _path)])
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            turns = row["turns"]
            code, counts = codes(turns, set(row["seen"] or ()))
            numbers = [t["turn"] for t in turns if t["turn"] is not None]
            made = {last: [{"after": a, "came": c, "cost": cost, "edits": edits} for a in range(4) for c, (cost, edits) in search(code, a, last).items()] for last in (False, True)}
            out.append({k: row[k] for k in ("conv_id", "part", "nth")} | counts | {"least": min(numbers, default=None), "most": max(numbers, default=None), "different": len(set(numbers)), "first": turns[0]["role"][:1], "final": turns[-1]["role"][:1], "paths": made[False], "ends": made[True]})
        yield _batch(out, schema)


CHAINED = f"conv_id long, part int, nth int, final boolean, after int, edits string, {SUMMARY}"


def chain(rows: pa.Table) -> pa.Table:
    """Each segment's edits in the cheapest repair of the conversation, whose counts and edits stand at its final segment."""
    parts = sorted(rows.to_pylist(), key=lambda r: (r["part"], r["nth"]))
    best, steps = {NOTHING: (0, "")}, []
    for k, row in enumerate(parts):
        # edits put in turns before others only, so no segment's edits begin another's and the lesser of two stays the lesser
        to: dict[int, tuple] = {}
        for p in row["ends" if k == len(parts) - 1 else "paths"]:
            if p["after"] in best:
                cost, way = best[p["after"]]
                new = cost + p["cost"], way + p["edits"], p["after"], p["edits"]
                to[p["came"]] = min(to.get(p["came"], new), new)
        steps.append(to)
        best = {came: new[:2] for came, new in to.items()}
    came = min(best, key=lambda c: best[c])
    total = {c: sum(r[c] for r in parts) for c in ("blank", "duplicate", "truncated", "illegal")}
    total["illegal"] += sum(not legal(a["final"], b["first"]) for a, b in zip(parts, parts[1:], strict=False))
    numbered_ = [r for r in parts if r["least"] is not None]
    different = sum(r["different"] for r in numbered_) - sum(a["most"] == b["least"] for a, b in zip(numbered_, numbered_[1:], strict=False))
    total |= {"gaps": gaps(numbered_[0]["least"], numbered_[-1]["most"], different) if numbered_ else 0, "cost": best[came][0], "audit": best[came][1]}
    out = []
    for k in reversed(range(len(parts))):
        _, _, after, edits = steps[k][came]
        final = k == len(parts) - 1
        out.append({c: parts[k][c] for c in ("conv_id", "part", "nth")} | {"final": final, "after": after, "edits": edits} | (total if final else {}))
        came = after
    return pa.Table.from_pylist(out, schema=pa.schema([*_id, ("final", pa.bool_()), ("after", pa.int32()), ("edits", pa.string()), *_summary]))


def apply_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _batch([{k: r[k] for k in ("conv_id", "part", "nth")} | {"turns": repaired(r["turns"], r["edits"], r["after"])[0]} for r in batch.to_pylist()], pa.schema([*_id, ("turns", _kept)]))


def _seen(parts: DataFrame) -> DataFrame:
    """part, nth, seen: which turns of a segment came before in the conversation, role and text alike."""
    each = parts.select("conv_id", F.struct("part", "nth").alias("at"), F.posexplode("turns").alias("pos", "t")).select("conv_id", "t.sha", F.struct("at.part", "at.nth", "pos").alias("at"))
    first = each.groupBy("conv_id", "sha").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("c"), F.col("sha").alias("s"), "first")
    again = each.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("sha") == F.col("s"))).where(F.col("at") != F.col("first"))
    return again.groupBy("at.part", "at.nth").agg(F.collect_list("at.pos").alias("seen"))


def repair(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation, and its repaired turns.

    A conversation's turns go by number, null first, those of the same number by the SHA-256 of role, a zero and text; repeated rows are turns of
    their own, of which all but the first are duplicates. Null roles and texts are one space. A null id is a conversation's as well.
    audit: the edits in order, K keep, R retype, D delete, I insert. The repaired turns are rows (conv_id, part, nth, whole, turns), in order
    of part and nth; whole: the conversation has no other row. One that nothing is left of has a row without turns. Very long texts are moved
    once or twice like others. Conversations are sorted over all tasks, so one with a third of all turns lies in many; its edits
    meet in one task, about 30 bytes a turn. An empty table gives no rows. Other columns aren't read.
    """
    small_batches(turns.sparkSession)
    held = only(turns, conv_id=id_col, turn=turn_col, role=role_col, text=text_col)
    held = held.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    held = numbered(held.withColumn("sha", F.sha2(F.concat("role", F.lit("\0"), "text").cast("binary"), 256)), "row")
    order = ["conv_id", "turn", "sha", "row"]
    cut = stage(segments(held.repartitionByRange(*order).sortWithinPartitions(*order)), "segments")
    solved = stage(cut.where("whole").mapInArrow(solve_whole, WHOLE), "solved")
    parts = cut.where("not whole")
    paths = parts.join(_seen(parts), ["part", "nth"], "left").select("conv_id", "part", "nth", "turns", "seen").mapInArrow(solve_part, PATHS)
    chained = stage(paths.groupBy("conv_id").applyInArrow(chain, CHAINED), "chained")
    drop(held)
    applied = parts.drop("conv_id").join(chained, ["part", "nth"]).select("conv_id", "part", "nth", "turns", "after", "edits").mapInArrow(apply_part, f"conv_id long, part int, nth int, turns {KEPT}")
    few = ["conv_id", *COUNTS, "audit"]
    rows = ["conv_id", "part", "nth", "whole", "turns"]
    summary = solved.select(*few).unionByName(chained.where("final").select(*few))
    return summary, solved.withColumn("whole", F.lit(True)).select(*rows).unionByName(applied.withColumn("whole", F.lit(False)).select(*rows))


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, sha256 of the repaired turns `role:text`, joined by line ends. A long conversation's text runs through one task, as this digest asks for, and isn't held."""
    joined = turns.withColumn("text", F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, begun, any_ = None, hashlib.sha256(), False, False
        for batch in batches:
            done = []
            for conv, text, full in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "full")), strict=True):
                if any_ and conv != now:
                    done.append((now, sha.hexdigest()))
                    sha, begun = hashlib.sha256(), False
                now, any_ = conv, True
                if full:
                    sha.update((b"\n" if begun else b"") + text.encode("utf-8", "surrogatepass"))
                    begun = True
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], pa.int64()), pa.array([s for _, s in done])], names=["conv_id", "sha256"])
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([sha.hexdigest()])], names=["conv_id", "sha256"])

    at_once = joined.where("whole").select("conv_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    many = joined.where("not whole").select("conv_id", "part", "nth", "text", (F.size("turns") > 0).alias("full"))
    return at_once.unionByName(many.repartition("conv_id").sortWithinPartitions("conv_id", "part", "nth").mapInArrow(run, "conv_id long, sha256 string"))
