"""The store's layers and leaves against plain dictionaries, and what an edit writes."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lectern.sources import store
from lectern.sources.store import ConflictError, Store


def rows(spark, held):
    return spark.createDataFrame([(v, i, t) for v, own in held.items() for i, t in enumerate(own)], "video_id string, x long, t string")


def ids(spark, names):
    return spark.createDataFrame([(n,) for n in names], "video_id string")


def state(s, at=None):
    out = {}
    for r in s.table("a", at).orderBy("video_id", "x").collect():
        out.setdefault(r.video_id, []).append(r.t)
    return out


def layers(s):
    return [len(x) for x in s.pointer()["relations"]["a"]["leaves"].values()]


def bytes_below(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if not f.endswith(".crc"))


@pytest.mark.parametrize("named", [200, 0])
def test_random_edits(spark, tmp_path, monkeypatch, named):
    """Edits, deletions and new videos; old pointers keep their rows; layers stay few."""
    monkeypatch.setattr(store, "NAMED", named)
    rng = random.Random(named)
    s = Store(spark, str(tmp_path / "s"), ("a",), depth=1)
    held = {f"v{i}": [f"{i}.{k}" for k in range(rng.randrange(1, 4))] for i in range(12)}
    s.commit({"a": rows(spark, held)}, 0)
    seen = {}
    for k in range(1, 11):
        some = rng.sample([*held, f"new{k}"], rng.randrange(1, 4))
        new = {v: [f"{k}.{n}" for n in range(rng.randrange(0, 3))] for v in some}
        others = {"v0": ["not asked for"]} if "v0" not in new else {}
        s.commit({"a": rows(spark, new | others)}, k, ids(spark, some))
        held = {v: t for v, t in (held | new).items() if t}
        if k in (3, 7):
            seen[k] = (s.pointer(), dict(held))
        part = s.narrowed(s.pointer(), ids(spark, [some[0]]))
        assert state(s, part) == {v: t for v, t in held.items() if v == some[0]}
    assert state(s) == held and max(layers(s)) <= store.LAYERS + 2
    assert all(state(s, at) == then for at, then in seen.values())
    assert s.vacuum() > 0 and state(s) == held
    with pytest.raises(ConflictError):
        s.commit({"a": rows(spark, {"v1": ["x"]})}, 3, ids(spark, ["v1"]))


def test_full_leaves_split(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), ("a",), depth=0, split_bytes=4_000)
    held = {f"v{i}": [os.urandom(100).hex()] for i in range(120)}
    s.commit({"a": rows(spark, held)}, 0)
    leaves = s.pointer()["relations"]["a"]["leaves"]
    assert len(leaves) > 4 and all(x["bytes"] < 12_000 for y in leaves.values() for x in y) and state(s) == held
    s.commit({"a": rows(spark, {"v3": ["z"]})}, 1, ids(spark, ["v3"]))
    assert state(s) == held | {"v3": ["z"]} and s.required("a", "v3").count() == 1
    one = Store(spark, str(tmp_path / "one"), ("a",), depth=0, split_bytes=100)
    one.commit({"a": rows(spark, {"v": ["x"] * 500})}, 0)  # one video cannot be split
    assert list(one.pointer()["relations"]["a"]["leaves"]) == ["0-0"]


def test_an_edit_writes_what_it_edits(spark, tmp_path):
    """Bytes of an edit of one video, among 1, 100 and 10,000."""
    wrote = {}
    for n in (1, 100, 10_000):
        s = Store(spark, str(tmp_path / str(n)), ("a",), depth=2)
        s.commit({"a": spark.range(n).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("video_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("x"), F.md5(F.col("id").cast("string")).alias("t"))}, 0)
        before = bytes_below(s.root)
        own = s.narrowed(s.pointer(), s.one("v0"))
        s.commit({"a": s.table("a", own).withColumn("t", F.lit("edited"))}, 1, s.one("v0"))
        wrote[n] = bytes_below(s.root) - before
        assert s.table("a").where("t = 'edited'").count() == 10 and s.table("a").count() == 10 * n
    assert wrote[10_000] < 1.5 * wrote[1] and wrote[10_000] < 10_000


def test_schemas_meet(spark, tmp_path):
    """An edit may bring new columns, leave some out, or have narrower numbers."""
    s = Store(spark, str(tmp_path / "s"), ("a",), depth=0)
    s.commit({"a": rows(spark, {"v": ["x"], "w": ["y"]})}, 0)
    s.commit({"a": spark.createDataFrame([("v", 7, True)], "video_id string, x int, more boolean")}, 1, ids(spark, ["v"]))
    got = {r.video_id: (r.x, r.t, r.more) for r in s.table("a").collect()}
    assert got == {"v": (7, None, True), "w": (0, "y", None)} and s.table("a").schema["x"].dataType.simpleString() == "bigint"
    s.commit({"a": rows(spark, {"u": ["new"]}).withColumn("video_id", F.lit(None).cast("string"))}, 2, ids(spark, [None, "u"]))
    assert s.table("a").count() == 2


def test_relations_kept_by_another_key(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), ("u", "g"), keys={"u": "id", "g": None}, depth=1)
    up = lambda *x: spark.createDataFrame(list(x), "id string, name string")
    s.commit({"u": up(("1", "a"), ("2", "b")), "g": up(("x", "y"))}, 0)
    s.commit({"u": up(("2", "c")), "g": up(("z", "z"))}, 1, ids(spark, ["2"]))
    assert sorted(map(tuple, s.table("u").collect())) == [("1", "a"), ("2", "c")] and s.table("g").first().id == "z"
    assert s.table("u", s.narrowed(s.pointer(), ids(spark, ["2"]))).count() == 2
