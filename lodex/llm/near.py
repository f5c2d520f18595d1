"""Near copies: ball hashing over block fingerprints finds candidates, the exact Jaccard similarity of their word shingles decides.

A single SimHash of 64 bits differs in 3 to 11 bits between texts whose five-word shingles are similar by 0.8, too many for a
ball. So each text has several block fingerprints: four least hashes of its shingles, which must be equal, and a few
bits, one-bit least hashes, which differ by (1 - similarity) / 2 each. Every fingerprint emits itself and all variants
within half the radius, as in simhash; those that meet at a variant are within the radius, and candidates.

At a similarity of 0.8 two texts meet in none of the blocks with a chance of about 5 in a million, and more similar ones less often;
texts that share a passage, similar by 0.4, meet in a third of the cases.
Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodex.llm.components import components
from lodex.llm.simhash import SEED, masks
from lodex.llm.support import drop, small_batches, stage, text_slices, with_rows, words_of

#: Blocks, least hashes of each that must be equal, its bits, the least hashes that bits are taken from, and the radius.
BLOCKS, LEASTS, BITS, POOL, RADIUS = 28, 4, 10, 64, 2
#: Rows that are held against each other in one task, and shingles that are hashed at a time.
TOGETHER, AT_ONCE = 1000, 1 << 13
_rng = np.random.default_rng(SEED)
FACTORS = _rng.integers(1, 1 << 63, BLOCKS * LEASTS + POOL, dtype=np.uint64) | np.uint64(1)
SHIFTS = _rng.integers(1, 1 << 63, BLOCKS * LEASTS + POOL, dtype=np.uint64)
PICKED = np.array([_rng.choice(POOL, BITS, replace=False) for _ in range(BLOCKS)])
A, B, C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * B
    return x ^ (x >> np.uint64(29))


def shingles(texts: pa.Array, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The different hashes of each text's shingles, ascending, and their bounds by text. A text of fewer words is one shingle, one without words has none."""
    import xxhash

    lower = pc.ascii_lower(pc.cast(texts, pa.large_string() if pa.types.is_large_binary(texts.type) else pa.string(), safe=False))
    which, bounds, names = words_of(pc.cast(lower, texts.type))
    of = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), SEED) for w in names], dtype=np.uint64)
    one = of[which] if len(which) else np.zeros(0, dtype=np.uint64)
    many = np.diff(bounds)
    doc = np.repeat(np.arange(len(many)), many)
    place = np.arange(len(which)) - bounds[:-1][doc]
    found, there = _mixed(one * C), place >= words - 1
    short_end = np.zeros(len(which), dtype=bool)
    short_end[bounds[1:][(many > 0) & (many < words)] - 1] = True
    value = found.copy()
    for n in range(2, words + 1):
        longer = found.copy()
        longer[1:] = _mixed(found[:-1] * A + one[1:] * C + np.uint64(n))
        found = longer
        reach = place >= n - 1
        value[reach] = found[reach]
    there |= short_end
    doc, value = doc[there], value[there]
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return value[new], np.searchsorted(doc[new], np.arange(len(many) + 1))


def fingerprints(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """By text, its block fingerprints as signed longs; those of different blocks differ."""
    least = np.full((len(bounds) - 1, len(FACTORS)), np.iinfo(np.uint64).max, dtype=np.uint64)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    for begin in range(0, len(hashes), AT_ONCE):
        x = hashes[begin : begin + AT_ONCE, None] * FACTORS + SHIFTS
        x ^= x >> np.uint64(32)
        here = doc[begin : begin + AT_ONCE]
        starts = np.flatnonzero(np.concatenate([[True], here[1:] != here[:-1]]))
        least[here[starts]] = np.minimum(least[here[starts]], np.minimum.reduceat(x, starts, axis=0))
    equal = np.arange(BLOCKS, dtype=np.uint64) * C
    for k in range(LEASTS):
        equal = _mixed((equal ^ least[:, k * BLOCKS : (k + 1) * BLOCKS]) * A)
    bit = (least[:, BLOCKS * LEASTS :] >> np.uint64(16)) & np.uint64(1)
    bits = (bit[:, PICKED] << np.arange(BITS, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)
    return (((equal >> np.uint64(BITS)) << np.uint64(BITS)) | bits).view(np.int64)


def similar(common: np.ndarray, one: np.ndarray, other: np.ndarray, at_least: float) -> np.ndarray:
    """Whether so many common shingles of so many each are enough; two texts without words are alike."""
    return common >= at_least * (one + other - common)


def fingerprinted(docs: DataFrame, words: int) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches):
            made = fingerprints(*shingles(texts, words))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, made.size + 1, BLOCKS), pa.int32()), pa.array(made.ravel()))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), rows.column("row"), lists], names=["doc_id", "row", "fps"])

    return docs.mapInArrow(make, "doc_id long, row long, fps array<long>")


def shingled(docs: DataFrame, words: int) -> DataFrame:
    """row, held: the different hashes of its shingles as bytes."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches):
            hashes, bounds = shingles(texts, words)
            yield pa.RecordBatch.from_arrays([rows.column("row"), pa.array([hashes[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], names=["row", "held"])

    return docs.mapInArrow(make, "row long, held binary")


LINKS = "u long, v long"


def _links(u: list[int], v: list[int]) -> pa.Table:
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _sets(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=np.uint64) for x in column.to_pylist()]


def star(one: pa.Table, rows: pa.Table, at_least: float) -> pa.Table:
    """Links of the one to the rows that are similar to it."""
    if not len(one) or not len(rows):
        return _links([], [])
    first, u, sets = _sets(one.column("held"))[0], one.column("u")[0].as_py(), _sets(rows.column("held"))
    sizes = np.array([len(s) for s in sets])
    every = np.concatenate([*sets, np.zeros(0, dtype=np.uint64)])
    at = np.minimum(np.searchsorted(first, every), max(0, len(first) - 1))
    hit = first[at] == every if len(first) else np.zeros(len(every), dtype=bool)
    common = np.bincount(np.repeat(np.arange(len(sets)), sizes)[hit], minlength=len(sets))
    near = rows.column("v").to_numpy()[similar(common, sizes, len(first), at_least)]
    return _links([u] * len(near), near.tolist())


#: What a row does among those it is held against: it is asked, it asks, or both.
ASKED, ASKS, BOTH = 0, 1, 2


def across(rows: pa.Table, at_least: float) -> pa.Table:
    """Links that join all components whose rows are similar: each row that asks is held against all that are asked."""
    does = rows.column("does").to_numpy()
    asked = does != ASKS
    row, root = rows.column("row").to_numpy(), np.unique(rows.column("root").to_numpy(), return_inverse=True)[1]
    sets = _sets(rows.column("held"))
    sizes = np.array([len(s) for s in sets])
    held = np.flatnonzero(asked)
    entries = np.concatenate([*(sets[k] for k in held), np.zeros(0, dtype=np.uint64)])
    order = np.argsort(entries, kind="stable")
    entries, holder = entries[order], np.repeat(held, sizes[held])[order]
    u, v = [], []
    for k in np.flatnonzero(does != ASKED):
        begin, end = np.searchsorted(entries, sets[k], "left"), np.searchsorted(entries, sets[k], "right")
        run = end - begin
        inside = np.arange(run.sum()) + np.repeat(begin - np.cumsum(run) + run, run)
        common = np.bincount(holder[inside], minlength=len(sets))  # a row holds a shingle once
        for j in np.flatnonzero(similar(common, sizes[k], sizes, at_least) & (root != root[k]) & asked):
            if root[j] != root[k]:
                u.append(int(row[k]))
                v.append(int(row[j]))
                root[root == root[j]] = root[k]
        if (root == root[0]).all():
            break
    return _links(u, v)


def _same_sets(members: DataFrame, key: str, first: str = "row") -> DataFrame:
    """One key of all that hold the same rows, with the row u whose column first is least and the number of rows; only those of two rows and more."""
    held = members.groupBy(key).agg(F.min_by("row", first).alias("u"), F.count("*").alias("n"), F.sum(F.xxhash64("row").cast("decimal(38,0)")).alias("which")).where("n > 1")
    return held.groupBy("u", "n", "which").agg(F.min(key).alias(key)).select(key, "u", "n")


def _with_known(each: DataFrame) -> DataFrame:
    """fp, row, first: rows that share a fingerprint; least first is the one that shares most with others, as an original does with its copies."""
    shared = stage(each.join(each.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1"), "fp"), "shared")
    known = shared.groupBy("row").agg(F.sum("n").alias("known"))
    return shared.join(known, "row").select("fp", "row", F.struct((-F.col("known")).alias("known"), "row").alias("first"))


def _stars(docs: DataFrame, members: DataFrame, words: int, at_least: float) -> DataFrame:
    """Links of each (u, row) of members that are similar; so many rows at a time as TOGETHER."""
    pairs = stage(members.where("row <> u").select("u", F.col("row").alias("v")).distinct(), "pairs")
    held = stage(shingled(docs.join(pairs.select(F.explode(F.array("u", "v")).alias("row")).distinct(), "row", "left_semi"), words), "shingles")
    parts = stage(pairs.groupBy("u").agg(F.ceil(F.count("*") / TOGETHER).alias("parts")), "parts")
    some = pairs.join(parts, "u").withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts"))).join(held.withColumnRenamed("row", "v"), "v").select(F.col("u").alias("to"), F.col("part").alias("piece"), "v", F.col("held").alias("held"))
    each = parts.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).join(held.withColumnRenamed("row", "u"), "u").select("u", "part", "held")
    links = stage(each.groupBy("u", "part").cogroup(some.groupBy("to", "piece")).applyInArrow(lambda a, b: star(a, b, at_least), LINKS), "links")
    drop(pairs, held, parts)
    return links


def _meets_here(f: Column, g: Column) -> Column:
    """Whether rows of different components have the fingerprints f and g, and this point is the one that looks at the two.

    Equal ones meet at all their variants, others within two bits at two points: each other's, or the two between. Equal
    ones are looked at where they are the point itself, others at the lesser of the two points.
    """
    point = F.col("point")
    apart = F.least(f["a"], g["a"]) != F.greatest(f["b"], g["b"])
    return apart & ((point < f["fp"].bitwiseXOR(g["fp"]).bitwiseXOR(point)) | ((f["fp"] == point) & (g["fp"] == point)))


def _across(docs: DataFrame, rooted: DataFrame, words: int, at_least: float) -> DataFrame:
    """Links between the components that meet at a point. rooted: fps, row, root."""
    masks_ = F.array(*[F.lit(m) for m in masks(RADIUS // 2) if 0 <= m < 1 << BITS])
    flip = lambda c: F.explode(F.transform(masks_, lambda m: F.col(c).bitwiseXOR(m)))
    deal = lambda many: F.pmod(F.xxhash64("row"), F.col(many)).cast("int")
    every = lambda many: F.explode(F.sequence(F.lit(0), F.col(many) - 1))
    whole = lambda many: F.ceil(many / TOGETHER).cast("int")
    cut = rooted.groupBy("root").agg(whole(F.count("*")).alias("cuts")).where("cuts > 1")
    placed = stage(rooted.join(cut, "root", "left").select("fps", "row", "root", F.coalesce(deal("cuts"), F.lit(0)).alias("part")), "placed")
    each = placed.select(F.explode("fps").alias("fp"), "row", "root", "part")
    ends = each.groupBy("fp").agg(F.min("root").alias("a"), F.max("root").alias("b"))
    # only fingerprints whose equal part others of another component have can meet these
    equal = F.shiftright("fp", BITS)
    both = ends.groupBy(equal.alias("equal")).agg(F.min("a").alias("least"), F.max("b").alias("most")).where("least <> most").select("equal")
    ends = stage(ends.join(both, equal == F.col("equal"), "left_semi"), "ends")
    met = ends.select(flip("fp").alias("point"), "a", "b").groupBy("point").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    points = stage(met.where("a <> b").select("point"), "points")
    # a point holds at most as many fingerprints as there are variants of one
    around = points.select("point", flip("point").alias("fp")).join(ends, "fp").groupBy("point").agg(F.collect_list(F.struct("fp", "a", "b")).alias("fps"))
    looked = around.select("point", F.explode(F.filter("fps", lambda f: F.exists("fps", lambda g: _meets_here(f, g)))).alias("f")).select("point", "f.fp")
    there = stage(looked.join(each.groupBy("fp", "root", "part").agg(F.count("*").alias("k")), "fp"), "there")
    by_root = there.groupBy("point", "root").agg(F.sum("k").alias("k")).groupBy("point").agg(F.max(F.struct("k", "root")).alias("l"), F.sum("k").alias("n"))
    main = stage(by_root.where(F.col("l.k") * 2 > F.col("n")).select("point", F.col("l.root").alias("most")), "main")
    # where one component has most of a point's rows, these don't come to the point: the others go to the component's parts
    few = there.join(main, "point", "left").where("most is null or root <> most").select("point", "fp", "root", "most").distinct()
    members = stage(few.join(each.select("fp", "root", "row"), ["fp", "root"]).select("point", "row", "root", "most").distinct(), "members")
    goes = members.where("most is not null")
    parts = there.select("point", F.col("root").alias("most"), "part").distinct()
    sent = stage(goes.join(parts, ["point", "most"]).select("most", "part", "row", "root").distinct(), "sent")
    asked_parts = sent.groupBy("most", "part").agg(whole(F.count("*")).alias("groups"))
    to_parts = sent.join(asked_parts, ["most", "part"]).select(F.lit(True).alias("main"), F.col("most").alias("at"), F.col("part").alias("i"), deal("groups").alias("j"), "row", "root", F.lit(ASKS).alias("does"))
    of_parts = placed.join(asked_parts.withColumnRenamed("most", "root"), ["root", "part"]).select(F.lit(True).alias("main"), F.col("root").alias("at"), F.col("part").alias("i"), every("groups").alias("j"), "row", "root", F.lit(ASKED).alias("does"))
    # rows at the point outside its largest component, which are few, ask all of its rows there: these are cut into parts, and those into groups
    held_by = members.groupBy("point", "root").agg(F.count("*").alias("m"), F.sum(F.xxhash64("row").cast("decimal(38,0)")).alias("which"))
    largest = held_by.groupBy("point").agg(F.sum("m").alias("n"), F.sum("which").alias("which"), F.max(F.struct("m", "root")).alias("l")).where("n > l.m")
    once = largest.groupBy("n", "which").agg(F.min(F.struct("point", "l")).alias("p"))  # one point of all that hold the same rows
    counted = once.select("p.point", F.col("p.l.root").alias("most"), whole(F.col("n")).alias("parts"), whole(F.col("n") - F.col("p.l.m")).alias("groups"))
    dealt = stage(members.select("point", "row", "root").join(counted, "point"), "dealt")
    outside, one = F.col("root") != F.col("most"), F.col("parts") == 1
    roles = F.when(one, F.array(F.when(outside, BOTH).otherwise(ASKED))).when(outside, F.array(F.lit(ASKED), F.lit(ASKS))).otherwise(F.array(F.lit(ASKED)))
    acting = dealt.withColumn("does", F.explode(roles))
    asked = acting.where(F.col("does") != ASKS).select(F.lit(False).alias("main"), F.col("point").alias("at"), deal("parts").alias("i"), every("groups").alias("j"), "row", "root", "does")
    asking = acting.where(F.col("does") == ASKS).select(F.lit(False).alias("main"), F.col("point").alias("at"), every("parts").alias("i"), deal("groups").alias("j"), "row", "root", "does")
    open_ = stage(to_parts.unionByName(of_parts).unionByName(asked).unionByName(asking), "open")
    held = stage(shingled(docs.join(open_.select("row").distinct(), "row", "left_semi"), words), "shingles")
    more = stage(open_.join(held, "row").groupBy("main", "at", "i", "j").applyInArrow(lambda t: across(t, at_least), LINKS), "more")
    drop(placed, ends, points, there, main, members, sent, dealt, open_, held)
    return more


def near_copies(docs: DataFrame, at_least: float = 0.8, words: int = 5, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """doc_id, component_id, kept, row of every document, linked to those whose shingles' Jaccard similarity is at_least or more.

    docs is a table at rest. A component is all that links reach; one row of it is kept, one with the smallest id, null
    ids last. Null and empty texts are alike. Repeated rows are near copies. Long texts are compared whole. An empty table
    gives no rows; other columns aren't read. row_col: as in simhash.near_duplicates. at_least is 0.8 or more: below it the
    blocks miss more.

    First the rows that have a fingerprint in common are held against the one of them that shares most fingerprints with
    others; that leaves few components where groups are large. Then, where components meet, rows outside the largest are
    held against all, TOGETHER by TOGETHER; where the largest has most of the rows, they are sent to its parts, each of
    which has its rows once for all points.
    """
    if not 0.8 <= at_least <= 1:
        raise ValueError("at_least is 0.8 to 1")
    small_batches(docs.sparkSession)
    docs = with_rows(docs, row_col, doc_id=id_col, text=text_col)
    made = stage(fingerprinted(docs, words), "fingerprints")
    each = made.select(F.explode("fps").alias("fp"), "row")
    shared = stage(_with_known(each), "known")
    alike = stage(_same_sets(shared, "fp", "first"), "alike")
    links = _stars(docs, shared.join(alike, "fp"), words, at_least)
    roots = stage(components(links).withColumnRenamed("node", "row"), "roots")
    rooted = stage(made.join(roots, "row", "left").select("fps", "row", F.coalesce("root", "row").alias("root")), "rooted")
    more = _across(docs, rooted, words, at_least)
    if not more.isEmpty():
        roots = stage(components(links.unionByName(more)).withColumnRenamed("node", "row"), "roots")
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    linked = made.select("doc_id", "row").join(roots, "row")
    best = linked.groupBy("root").agg(F.min(first).alias("best"))
    named = linked.select("row", "root").join(best, "root").select("row", "best")
    alone = F.col("best").isNull()
    return made.select("doc_id", "row").join(named, "row", "left").select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("component_id"), (alone | (F.col("best.row") == F.col("row"))).alias("kept"), "row")
