"""Versioned tables with atomic commits and compare-and-set (SNK1-SNK7, SNK10), edited by merge on read.

A relation that is kept by a key (its video id) lies in leaves of a directory of
hashes: leaf d-b holds the keys whose hash ends in the d bits of b.  A leaf that
fills up splits into leaves of more bits, the others stay (extendible hashing).

A leaf is a base and a few layers over it.  An edit of some keys writes one layer:
their new rows, and the keys themselves, whose rows in older layers are gone.  So it
writes in proportion to what it edits, not to the leaf.  A read drops the rows of
older layers by one join with the keys, which are few.  Of more than a few layers, one
that is not much smaller than the one below is merged with it in the same commit;
beyond those few, sizes at least double from layer to layer, so a leaf has a
logarithmic number of them, and each byte is rewritten as often.  Rows lie by key, so that a read of one video skips
most of a file.

A commit writes directories of its own, then publishes one small pointer file by a
rename that does not overwrite.  (On stores whose rename copies, such as S3, two
writers may both pass; put the pointers on a store with atomic renames there.)
Readers resolve the pointer once, so they see all of a commit or nothing.  A crash
before the rename leaves directories that no pointer names: recovery is to ignore
them, `vacuum` deletes them.  The pointer's revision is checked before; a stale
writer gets a conflict.
"""

from __future__ import annotations

import json
import math
import re
import uuid
from functools import reduce, wraps
from threading import RLock

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class ConflictError(RuntimeError):
    """Another commit came first; read again and repeat the edit."""


#: Bits of the leaves that a new relation starts with, and bytes beyond which a leaf splits.
DEPTH, SPLIT_BYTES = 6, 4 << 30
#: Layers that a leaf may have without a merge; beyond them, a layer is merged with those above it once they hold this share of its bytes.
LAYERS, MERGE = 4, 0.5
#: Keys that a read may name in its filter, so that it reaches the scan, and a layer in the pointer; more are joined, and kept in a directory.
NAMED = 200
#: Older commits that vacuum leaves.
COMMITS = 10
#: The relations of an application that may be committed (SNK4), and the keys of those that are not kept by video; None: as a whole.
RELATIONS = ("raw", "cleaned", "segments", "documents", "changes", "history", "glossary", "uploads", "business", "explanations", "markdown", "jobs")
KEYS = {"glossary": None, "uploads": "id", "jobs": "job_id"}
#: What is kept of a relation for each key, in a relation of its own that each commit keeps up to date: columns and their aggregates.
TALLIES = {"raw": {"n": "count(*)", "duration_ms": "max(end_ms)"}, "cleaned": {"n": "count(*)"}, "segments": {"n": "count(*)"}, "changes": {"n": "count(*)"}, "business": {"n": "count(*)"}}
_DIRECTORY = r"v-[0-9a-f]{32}(/_leaf=\d+-\d+)?"


def tally(relation: str) -> str:
    """The relation that holds what is kept of another one for each key."""
    return f"{relation}_tally"


def _leaf(hashed: int, leaves) -> str:
    """The leaf of a hash."""
    return next(k for d in range(64) if (k := f"{d}-{hashed % (1 << d)}") in leaves)


class Store:
    def __init__(self, spark: SparkSession, root: str, relations: tuple[str, ...] = RELATIONS, keys: dict[str, str | None] = KEYS, depth: int = DEPTH, split_bytes: int = SPLIT_BYTES, tallies: dict[str, dict[str, str]] = TALLIES):
        self.spark, self.root, self.relations, self.keys, self.depth, self.split_bytes, self.tallies = spark, root.rstrip("/"), relations, keys, depth, split_bytes, tallies

    # --- files

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _read(self, path: str) -> str | None:
        fs, p = self._fs(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, path: str, text: str) -> bool:
        """Create a file that must not exist yet, whole: write beside it, then rename without overwriting."""
        fs, p = self._fs(path)
        _, side = self._fs(f"{path}.{uuid.uuid4().hex}")
        out = fs.create(side, False)
        out.write(bytearray(text.encode()))
        out.close()
        done = not fs.exists(p) and fs.rename(side, p)
        if not done:
            fs.delete(side, False)
        return done

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def _bytes(self, directory: str) -> int:
        fs, p = self._fs(f"{self.root}/{directory}")
        return fs.getContentSummary(p).getLength()

    # --- pointers

    def pointer(self) -> dict:
        """{"revision": n, "relations": {name: {"schema": .., "whole": directory} or {"schema": .., "leaves": {leaf: [layer, ..]}}}} of the newest commit, its shape checked.

        A layer is {"rows": directory or null, "gone": directory, keys or null, "seq":
        revision, "bytes": n}; the first of a leaf is its base.
        """
        names = [n for n in self._names(f"{self.root}/_commits") if n.endswith(".json")]
        if not names:
            return {"revision": 0, "relations": {}}
        inside = lambda n, d: d is None or isinstance(d, list) or re.fullmatch(rf"{re.escape(n)}/{_DIRECTORY}", d)
        try:
            found = json.loads(self._read(f"{self.root}/_commits/{names[-1]}"))
            fine = found["revision"] == int(names[-1][:-5]) and all(isinstance(r["schema"], dict) and all(inside(n, d) for d in self._directories(r)) for n, r in found["relations"].items())
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            raise RuntimeError(f"{names[-1]} is no commit") from e
        if not fine:
            raise RuntimeError(f"{names[-1]} names another revision, or directories outside its relations")
        return found

    @staticmethod
    def _directories(relation: dict) -> list[str | None]:
        if "whole" in relation:
            return [relation["whole"]]
        return [layer[side] for layers in relation["leaves"].values() for layer in layers for side in ("rows", "gone")]

    def one(self, video_id: str) -> DataFrame:
        """A relation (video_id) of one video, which needs no job."""
        return self.spark.range(1).select(F.lit(video_id).alias("video_id"))

    def key_of(self, relation: str) -> str | None:
        return self.keys.get(relation, "video_id")

    def narrowed(self, at: dict, keys: DataFrame) -> dict:
        """The pointer for the rows of some keys (video_id) only: tables read by it open their leaves and return their rows; relations that are not kept by video stay whole."""
        few, hashes = self._named(keys)
        kept = {n: r for n, r in at["relations"].items() if "leaves" in r and self.key_of(n) == "video_id"}
        depth = max((int(k.split("-")[0]) for r in kept.values() for k in r["leaves"]), default=0)
        ends = hashes if few is not None else self._ends(keys, depth)
        part = {n: r | {"leaves": {k: r["leaves"][k] for k in {_leaf(h, r["leaves"]) for h in ends}}} for n, r in kept.items()}
        return at | {"relations": at["relations"] | part, "keys": keys if few is None else few}

    @staticmethod
    def _named(keys: DataFrame) -> tuple[list[str] | None, list[int]]:
        """The keys (video_id) and their hashes, if they are few enough to be named."""
        found = keys.select(F.col("video_id").cast("string").alias("k"), F.xxhash64(F.col("video_id").cast("string")).alias("h")).where("k IS NOT NULL").distinct().limit(NAMED + 1).collect()
        return ([r.k for r in found], [r.h for r in found]) if len(found) <= NAMED else (None, [])

    @staticmethod
    def _ends(keys: DataFrame, depth: int) -> list[int]:
        """The last bits of the keys' hashes: as many as leaves at most."""
        return [r.h for r in keys.select(F.pmod(F.xxhash64(F.col("video_id").cast("string")), F.lit(1 << depth)).alias("h")).distinct().collect()]

    # --- reading

    def _layers(self, layers: list[dict], key: str, schema: StructType, seq: bool = False, only: list | DataFrame | None = None) -> DataFrame:
        """The rows of some layers of whatever leaves that no later layer takes away."""
        paths = [f"{self.root}/{x['rows']}" for x in layers if x["rows"]]
        own = StructType([*schema.fields]).add("_seq", "long")
        if not paths:
            return self.spark.createDataFrame([], own if seq else schema)
        rows = self.spark.read.schema(own).parquet(*paths)
        if isinstance(only, list):
            rows = rows.where(F.col(key).isin(only))
        elif only is not None:
            rows = rows.join(only.select(F.col("video_id").alias(key)).distinct(), key, "left_semi")
        gone = self._gone(layers)
        if gone is not None:
            gone = gone.where(F.col("_key").isin(only)) if isinstance(only, list) else gone
            last = gone.groupBy("_key").agg(F.max("_seq").alias("_last"))
            rows = rows.join(last, F.col(key).cast("string") == F.col("_key"), "left").where(F.col("_last").isNull() | (F.col("_seq") >= F.col("_last")))
        return rows.select(*schema.names, *(["_seq"] if seq else []))

    def _gone(self, layers: list[dict]) -> DataFrame | None:
        """(_key, _seq) of the keys whose rows in older layers are gone; keys that a layer names need no file."""
        files = sorted({f"{self.root}/{x['gone']}" for x in layers if isinstance(x["gone"], str)})
        named = [(k, x["seq"]) for x in layers if isinstance(x["gone"], list) for k in x["gone"]]
        schema = "_key string, _seq long"
        stored = self.spark.read.schema(schema).parquet(*files) if files else None
        if not named:
            return stored
        told = self.spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(k).alias("_key"), F.lit(n).cast("long").alias("_seq")) for k, n in sorted(set(named))))))
        return told if stored is None else stored.unionByName(told)

    def table(self, relation: str, at: dict | None = None) -> DataFrame:
        """A relation as of a pointer (the newest by default); SRC13: FileNotFoundError if there is none."""
        at = at or self.pointer()
        where = at["relations"].get(relation)
        if where is None:
            raise FileNotFoundError(relation)
        schema = StructType.fromJson(where["schema"])  # an empty relation has no files to tell its schema
        if "whole" in where:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{where['whole']}")
        key = self.key_of(relation)
        return self._layers([x for layers in where["leaves"].values() for x in layers], key, schema, only=at.get("keys") if key == "video_id" else None)

    def required(self, relation: str, video_id: str, at: dict | None = None) -> DataFrame:
        """SRC13: one video's rows of a relation; FileNotFoundError if there are none."""
        one = self.one(video_id)
        t = self.table(relation, self.narrowed(at or self.pointer(), one))
        if t.isEmpty():
            raise FileNotFoundError(f"{relation} of {video_id}")
        return t

    # --- writing

    def _leaf_of(self, key: str, leaves: dict) -> Column:
        """The leaf of a row's key, as a column."""
        by: dict[int, list[int]] = {}
        for k in leaves:
            d, b = map(int, k.split("-"))
            by.setdefault(d, []).append(b)
        end = lambda d: F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << d))
        return F.coalesce(*(F.when(end(d).isin(bits), F.concat(F.lit(f"{d}-"), end(d).cast("string"))) for d, bits in sorted(by.items())))

    def _write(self, relation: str, df: DataFrame, key: str, leaves: dict) -> dict[str, tuple[str, int]]:
        """Rows dealt to their leaves, by key within each: (directory, bytes) of the leaves that got any."""
        path = f"{relation}/v-{uuid.uuid4().hex}"
        df.withColumn("_leaf", self._leaf_of(key, leaves)).hint("rebalance", "_leaf").sortWithinPartitions("_leaf", key).write.partitionBy("_leaf").parquet(f"{self.root}/{path}")
        found = {n.split("=")[1]: f"{path}/{n}" for n in self._names(f"{self.root}/{path}") if n.startswith("_leaf=")}
        return {k: (d, self._bytes(d)) for k, d in found.items()}

    def _base(self, relation: str, df: DataFrame, key: str, leaves: dict, schema: StructType, seq: int) -> dict[str, list[dict]]:
        """A base for each of the leaves, of rows with _seq; leaves that are too large are split, as often as their size asks for."""
        held = self._write(relation, df, key, leaves)
        full = {k: math.ceil(math.log2(n / self.split_bytes)) for k, (_, n) in held.items() if n > self.split_bytes}
        bases = lambda found, names: {k: [{"rows": found[k][0], "gone": None, "seq": seq, "bytes": found[k][1]}] if k in found else [] for k in names}
        out = bases(held, leaves)
        parts, layers = {}, []
        for k, more in full.items():
            if self._layers(out[k], key, schema).select(key).distinct().limit(2).count() < 2:
                continue  # one key cannot be split
            layers += out.pop(k)
            d, b = map(int, k.split("-"))
            parts |= {f"{d + more}-{b + (i << d)}": [] for i in range(1 << more)}
        if parts:
            split = self._write(relation, self._layers(layers, key, schema, seq=True), key, parts)
            out |= bases(split, parts)
        return out

    def _edited(self, relation: str, df: DataFrame, keys: DataFrame, named: tuple[list[str] | None, list[int]], before: dict, seq: int) -> dict:
        """The relation with the rows of some keys (video_id) replaced by those in df: one layer on their leaves, merged with lower ones where it must be."""
        key, leaves = self.key_of(relation), dict(before["leaves"])
        old, few = StructType.fromJson(before["schema"]), named[0]
        if few is None:
            gone = f"{relation}/v-{uuid.uuid4().hex}"
            names = keys.select(F.col("video_id").cast("string").alias("_key")).where("_key IS NOT NULL").distinct()
            names.withColumn("_seq", F.lit(seq).cast("long")).write.parquet(f"{self.root}/{gone}")
            names = self.spark.read.schema("_key string").parquet(f"{self.root}/{gone}")
            own = df.join(names, F.col(key).cast("string") == F.col("_key"), "left_semi")
            ends = self._ends(names.withColumnRenamed("_key", "video_id"), max(int(k.split("-")[0]) for k in leaves))
        else:
            gone, ends, own = few, named[1], df.where(F.col(key).cast("string").isin(few))
        own = own.withColumns({f.name: F.col(f.name).cast(f.dataType) for f in old.fields if f.name in df.columns and df.schema[f.name].dataType.simpleString() != f.dataType.simpleString()})
        schema = StructType([*old.fields, *(f for f in df.schema.fields if f.name not in old.names)])  # new columns are null in older rows
        rows = self._write(relation, own.withColumn("_seq", F.lit(seq).cast("long")), key, leaves)
        merged: dict[str, tuple[int, list[dict]]] = {}
        for k in {_leaf(h, leaves) for h in ends}:
            new, size = rows.get(k, (None, 0))
            layers = [*leaves[k], {"rows": new, "gone": gone if leaves[k] else None, "seq": seq, "bytes": size}]
            leaves[k], i = layers, len(layers) - 1
            while len(layers) > LAYERS and i and sum(x["bytes"] for x in layers[i:]) >= MERGE * layers[i - 1]["bytes"]:
                i -= 1
            if i < len(layers) - 1:
                merged[k] = (i, layers)
        whole = {k: x for k, (i, x) in merged.items() if i == 0}
        if whole:
            rewritten = self._base(relation, self._layers([y for x in whole.values() for y in x], key, schema, seq=True), key, dict.fromkeys(whole), schema, seq)
            leaves = {k: x for k, x in leaves.items() if k not in whole} | rewritten
        for k, (i, x) in merged.items():
            if i:
                leaves[k] = [*x[:i], self._merged(relation, k, x[i:], key, schema)]
        return {"schema": json.loads(schema.json()), "leaves": leaves}

    def _merged(self, relation: str, leaf: str, layers: list[dict], key: str, schema: StructType) -> dict:
        """One layer of several that are not the base."""
        rows = self._write(relation, self._layers(layers, key, schema, seq=True), key, {leaf: None}).get(leaf, (None, 0))
        gone = f"{relation}/v-{uuid.uuid4().hex}"
        self._gone(layers).groupBy("_key").agg(F.max("_seq").alias("_seq")).write.parquet(f"{self.root}/{gone}")
        return {"rows": rows[0], "gone": gone, "seq": layers[-1]["seq"], "bytes": rows[1]}

    def commit(self, changes: dict[str, DataFrame], expected_revision: int, videos: DataFrame | None = None) -> int:
        """SNK2: write the changed relations, and what is kept of them, and publish all together; the new revision.

        With videos (video_id; for a relation kept by another key, that key under this
        name), the frames hold all rows of these, and those of others stay as they
        are; rows of others in the frames are not looked at.  Without, and for
        relations that are new or kept as a whole, the frames are the relations.
        """
        if unknown := sorted(set(changes) - set(self.relations)):
            raise ValueError(f"not relations of this store: {', '.join(unknown)}")
        now = self.pointer()
        if now["revision"] != expected_revision:
            raise ConflictError(f"revision is {now['revision']}, not {expected_revision}")
        relations, revision = dict(now["relations"]), expected_revision + 1
        named = self._named(videos) if videos is not None else None
        counted = {tally(n): df.groupBy(self.key_of(n)).agg(*(F.expr(e).alias(c) for c, e in self.tallies[n].items())) for n, df in changes.items() if n in self.tallies}
        for name, df in (changes | counted).items():
            key = self.key_of(name)
            if key is None or key not in df.columns:
                path = f"{name}/v-{uuid.uuid4().hex}"
                df.write.parquet(f"{self.root}/{path}")
                relations[name] = {"schema": json.loads(df.schema.json()), "whole": path}
            elif videos is None or "leaves" not in relations.get(name, {}):
                leaves = dict.fromkeys(f"{self.depth}-{b}" for b in range(1 << self.depth))
                relations[name] = {"schema": json.loads(df.schema.json()), "leaves": self._base(name, df.withColumn("_seq", F.lit(revision).cast("long")), key, leaves, df.schema, revision)}
            else:
                relations[name] = self._edited(name, df, videos, named, relations[name], revision)
        # the name is the lock: of two writers with one expectation, one finds it taken
        if not self._put(f"{self.root}/_commits/{revision:012d}.json", json.dumps({"revision": revision, "relations": relations})):
            raise ConflictError(f"revision {revision} was published meanwhile")
        return revision

    def delete_video(self, video_id: str, expected_revision: int) -> tuple[int, int]:
        """SNK7: one video's rows out of every relation; (new revision, rows removed)."""
        one = self.one(video_id)
        part = self.narrowed(self.pointer(), one)
        removed = {n: t for n, r in part["relations"].items() if n in self.relations and "leaves" in r and self.key_of(n) == "video_id" and (t := self.table(n, part)).count()}
        n = sum(t.count() for t in removed.values())
        return self.commit({name: t.limit(0) for name, t in removed.items()}, expected_revision, one), n

    def vacuum(self) -> int:
        """SNK3: delete directories, and leaves of others, that the newest pointer does not name (no reader may be on an older one), and all but the last commits."""
        kept = {d for r in self.pointer()["relations"].values() for d in self._directories(r) if isinstance(d, str)}
        whole = {"/".join(d.split("/")[:2]) for d in kept}
        gone = []
        for name in self._names(self.root):
            for v in self._names(f"{self.root}/{name}") if name != "_commits" else []:
                at = f"{name}/{v}"
                gone += [at] if at not in whole else [f"{at}/{b}" for b in self._names(f"{self.root}/{at}") if b.startswith("_leaf=") and f"{at}/{b}" not in kept]
        commits = [n for n in self._names(f"{self.root}/_commits") if n.endswith(".json")]
        for path in [*gone, *(f"_commits/{n}" for n in commits[:-COMMITS])]:
            fs, p = self._fs(f"{self.root}/{path}")
            fs.delete(p, True)
        return len(gone)


def locked(act):
    """X5, SNK5: a method that commits to self.store, of which one runs at a time for each store in this process; as all commits count one revision, two edits of different videos wait for each other too.  Across processes the revision decides."""

    @wraps(act)
    def run(self, *args, **named):
        with _LOCKS_LOCK:
            own = _LOCKS.setdefault(self.store.root, RLock())
        with own:
            return act(self, *args, **named)

    return run


_LOCKS: dict[str, RLock] = {}
_LOCKS_LOCK = RLock()


def quarantine(rows: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """SNK10: rows without and with an error."""
    return rows.where(F.col(error).isNull()).drop(error), rows.where(F.col(error).isNotNull())


def write_documents(df: DataFrame, path: str) -> None:
    """SNK1: a JSON object a line, committed as one job; nulls are left out."""
    df.write.mode("errorifexists").partitionBy(*[c for c in ("partition",) if c in df.columns]).json(path)


def write_markdown(df: DataFrame, path: str) -> None:
    """SNK6: Markdown texts by partition and video, a file for each document; its bytes are the document's and one closing line feed."""
    closed = F.regexp_replace("markdown", r"\n\z", "")  # the writer ends each value with a line feed
    one = df.select("partition", "video_id", closed.alias("value")).repartition("partition", "video_id")
    one.write.mode("overwrite").option("lineSep", "\n").partitionBy("partition", "video_id").text(path)


def union_all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)
