import os
import random

import pytest
from pyspark.sql import functions as F

from lodex.config import EngineConfig
from lodex.engine import Engine
from lodex.sources import files as sources
from lodex.sources import listing as lists
from lodex.sources.files import fingerprint, mark_of, mark_sums
from lodex.sources.store import Conflict, Store

FILE, PART = "path string, mark int", "path string, record_type string, term string"


def tables(spark, held):
    """A first table of a row for each path, and a second of as many as its mark."""
    return {"files": spark.createDataFrame([(p, m) for p, m in held.items()], FILE), "records": spark.createDataFrame([(p, "xy"[k % 2], f"t{m}") for p, m in held.items() for k in range(m % 4)], PART)}


def content(found):
    return {n: sorted(map(tuple, found[n].select("path", "mark" if n == "files" else "term").collect())) for n in ("files", "records")}


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


def paths(spark, names):
    return spark.createDataFrame([(n,) for n in names], "path string")


def test_a_chain_of_deltas_reads_as_a_rebuild(spark, tmp_path):
    rng, folder = random.Random(4), str(tmp_path / "s")
    store, held = Store(spark, folder, 3), {f"p{k}": k for k in range(30)}
    store.save(tables(spark, held), root="r")
    for step in range(12):
        changed = {f"p{rng.randrange(40)}": rng.randrange(100) for _ in range(rng.randrange(4))}
        gone = {f"p{rng.randrange(40)}" for _ in range(rng.randrange(3))} - set(changed)
        touched = {p: held[p] for p in rng.sample(sorted(held), 2) if p not in changed and p not in gone}
        made = tables(spark, changed)
        made["files"] = tables(spark, {**changed, **touched})["files"]
        store.append(made, paths(spark, [*changed, *gone]), paths(spark, touched), step=step)
        held = {p: m for p, m in held.items() if p not in gone} | changed
        if step == 6:
            before = content(store.load())
            store.compact()
            assert content(store.load()) == before and store.meta()["deltas"] == []
    want = content(tables(spark, held))
    assert content(store.load(root="r")) == want and store.load(root="other") is None and store.meta()["step"] == 11
    store.compact()
    assert content(store.load()) == want
    assert store.expire(keep=1, older_than=0.0) > 0 and content(store.load()) == want and len(os.listdir(f"{folder}/_meta")) <= 2
    assert store.expire(keep=1, older_than=0.0) == 0


def test_a_change_costs_the_same_in_a_large_store(spark, tmp_path):
    wrote = []
    for n in (20, 2000):
        store = Store(spark, str(tmp_path / f"s{n}"), 4)
        store.save(tables(spark, {f"p{k}": k for k in range(n)}))
        before = size(store.folder)
        store.append(tables(spark, {"p3": 7}), paths(spark, ["p3"]))
        wrote.append(size(store.folder) - before)
    assert wrote[0] == pytest.approx(wrote[1], rel=0.02)


def test_two_writers_conflict(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), 1)
    first = store.save(tables(spark, {"a": 1}))
    store.append(tables(spark, {"b": 2}), paths(spark, ["b"]), parent=first)
    with pytest.raises(Conflict):
        store.append(tables(spark, {"c": 3}), paths(spark, ["c"]), parent=first)
    assert content(store.load())["files"] == [("a", 1), ("b", 2)]


def test_sums_follow_changes(spark):
    rows = spark.createDataFrame([(str(k), str(k * k)) for k in range(50)], "path string, content_hash string")
    one, other = (mark_sums(rows.where(x), "path", "content_hash").first() for x in ("path < '3'", "path >= '3'"))
    assert mark_of(int(a) + int(b) for a, b in zip(one, other, strict=True)) == fingerprint(rows, "path", "content_hash").first()[0]


@pytest.mark.parametrize("entries", [5000, 3])
def test_listing_on_executors_is_the_drivers(spark, tmp_path, entries):
    root = tmp_path / "a [b] + c%20d"
    rng = random.Random(1)
    for k in range(60):
        place = root / "/".join(rng.choice(["a", "b", "out", "ü", ".git"]) for _ in range(rng.randrange(4))) / f"f{k}{rng.choice(['.py', '.md', '.bin'])}"
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_text("x" * k)
    (root / "big.py").write_bytes(b"x" * (2 * 1024 * 1024 + 1))
    (root / ".gitignore").write_text("a/b/\nf1*.py\n!f11.py\n")
    config = EngineConfig(str(root))
    want = sources.walk(spark, config)
    made = lists.listing(spark, config.root, sources.wanted(spark, config), entries)
    assert sorted(map(tuple, made.select("path", "size", F.unix_millis("mtime")).collect())) == want and len(want) > 10
    some = [r[0] for r in want][::3] + ["a/b/x.py", "nowhere.py", "big.py"]
    assert sorted(r.path for r in sources.tree(spark, config, paths(spark, some)).collect()) == sorted(set(some) & {r[0] for r in want})
    by_spark = {r.path: bytes(r.content) for r in sources._by_spark(spark, config, made).collect()}
    assert by_spark == {r.path: bytes(r.content) for r in lists.contents(made, config.root).collect()} and set(by_spark) == {r[0] for r in want}
    assert lists.readable(f"file://{root}") and not lists.readable("viewfs://store/in")


def test_engine_follows_a_tree_by_deltas(spark, tmp_path):
    root, folder = tmp_path / "tree", str(tmp_path / "store")
    root.mkdir()
    for k in range(4):
        (root / f"m{k}.py").write_text(f"def f{k}():\n    '''Number {k}.'''\n    f{(k + 1) % 4}()\n")
    config = EngineConfig(str(root), dimensions=8)
    engine = Engine.load_or_build(spark, config, folder)
    (root / "m1.py").write_text("def f1():\n    other()\n\ndef other(): pass\n")
    (root / "m2.py").unlink()
    os.utime(root / "m3.py", (1, 1))
    engine = engine.refreshed(folder)
    store = Store(spark, folder)
    meta = store.meta()
    assert len(meta["deltas"]) == 1 and meta["fingerprint"] == fingerprint(engine.files, "path", "content_hash").first()[0]
    built = Engine.build(spark, config)
    key = lambda df, *c: sorted(map(tuple, df.select(*c).collect()), key=repr)
    for name, columns in (("files", ("path", "content_hash", "mtime")), ("symbols", ("path", "qualified_name", "start_line")), ("records", ("id", "text")), ("postings", ("id", "term", "tf", "len")), ("callers", ("to_path", "to_name", "caller_name"))):
        columns = [c for c in columns if c in getattr(built, name).columns]
        assert key(getattr(engine, name), *columns) == key(getattr(built, name), *columns), name
    assert engine.totals.first() == built.totals.first()
    delta = [r.path for r in spark.read.parquet(f"{folder}/{meta['deltas'][0]}/symbols").select("path").distinct().collect()]
    assert delta == ["m1.py"]  # the touched file was noted, not parsed
    assert engine.refreshed(folder) is engine and engine.search("number", "semantic", 3).count()
