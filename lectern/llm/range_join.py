"""Exact metric range join of embeddings.

Vectors are scaled to length one; cosine >= c is then a chord distance of at most
eps = sqrt(2 - 2c).  Each label (and vector length) has pivots of its own, picked by
hash, whose number grows with the root of the label's size; what all labels have
together is bounded, and where that runs out the smaller labels stay one cell, which
is compared in blocks, quadratic in its size.
Each vector has its home in the cell of its nearest pivot.  By the triangle
inequality a partner of x lives in the cell of pivot p only if
d(x,p) - d(x,home) <= 2 eps; and since both are points of a Euclidean space, only
if x is within eps of the plane between the two pivots, which is the sharper
bound.  x is replicated to the cells that pass both.  A cell joins its homes
against all it holds, independently of other cells, in blocks of bounded bytes:
one task compares two blocks, a slice at a time, and returns, for each home row, the number of links
and one link into its component there; pairs are never written out.

Equal vectors of a label (told by 128 bits) are one class with a multiplicity from the
start, numbered as the table of classes is written; ids only name the components in
the end.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.components import connected_components
from lectern.llm.workspace import Workspace, small_batches

#: Least pivots of a label, and most numbers that all pivots hold together (8 MB, all that goes to every task).
PIVOTS, PIVOT_NUMBERS = 8, 1 << 20
#: Numbers of a block (2 MB), vectors of a slice of it.
BLOCK_NUMBERS, SLICE = 1 << 18, 512
#: Largest components outside these bounds are scaled to one, lest squares over- or underflow.
LOW, HIGH = 1e-100, 1e100
_FAR = np.iinfo(np.int64).max


def _block(dim: int) -> int:
    """Vectors of a block."""
    return max(64, BLOCK_NUMBERS // max(1, dim))


def _cells(pivots: dict[tuple[str, int], np.ndarray], eps: float):
    """pivots: unit rows by (label, length); a label without any is one cell."""
    slack = 1e-9

    def run(batches):
        for b in batches:
            labels, x = b.column("label").to_pylist(), [np.asarray(v.as_py(), np.float64) for v in b.column("vec")]
            groups: dict[tuple[str, int], list[int]] = {}
            for i, (name, v) in enumerate(zip(labels, x)):
                groups.setdefault((name, len(v)), []).append(i)
            rows, cells, homes = [], [], []
            for key, own in groups.items():
                at, p = np.array(own), pivots.get(key)
                if p is None:
                    rows, cells, homes = [*rows, at], [*cells, np.zeros(len(at), np.int32)], [*homes, np.ones(len(at), bool)]
                    continue
                v = np.stack([x[i] for i in own])
                d = np.sqrt(np.maximum(0.0, 2 - 2 * (v / np.linalg.norm(v, axis=1, keepdims=True)) @ p.T))
                home = d.argmin(1)
                near = d[np.arange(len(v)), home][:, None]
                met, which = np.unique(home, return_inverse=True)  # distances of pivots are made for the homes of this batch only
                between = np.sqrt(np.maximum(0.0, 2 - 2 * p[met] @ p.T))[which]
                row, cell = np.nonzero((d - near <= 2 * eps + slack) & (d**2 - near**2 <= 2 * eps * between + slack))
                rows, cells, homes = [*rows, at[row]], [*cells, cell.astype(np.int32)], [*homes, cell == home[row]]
            if rows:
                taken = b.take(pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([*(taken.column(c) for c in ("label", "rep", "mult", "vec")), pa.array(np.concatenate(cells)), pa.array(np.concatenate(homes))], ["label", "rep", "mult", "vec", "cell", "home"])

    return run


def _blocks(cosine: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h, o = pdf[pdf.side == 0], pdf[pdf.side == 1]
        if not len(h) or not len(o):
            return pd.DataFrame({"rep": [], "links": [], "root": []}).astype("int64")
        x, y = (np.stack([np.asarray(v, np.float64) for v in t.vec]) for t in (h, o))
        hid, oid, mult = h.rep.to_numpy(), o.rep.to_numpy(), o.mult.to_numpy()
        xn, yn = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
        parts = []
        for at in range(0, len(x), SLICE):
            s = slice(at, at + SLICE)
            near = (x[s] @ y.T) / (xn[s][:, None] * yn) >= cosine
            parts.append((s, near & (hid[s][:, None] != oid)))
        links = np.concatenate([near @ mult for _, near in parts])
        low, top = hid.copy(), oid.copy()
        while True:
            before = low.copy(), top.copy()
            for s, near in parts:
                if near.any():
                    low[s] = np.minimum(low[s], np.where(near, top, _FAR).min(1))
                    top = np.minimum(top, np.where(near, low[s][:, None], _FAR).min(0))
            if (low == before[0]).all() and (top == before[1]).all():
                break
        # other rows may link only through homes of this block, so their roots are told as well
        some, also = links > 0, np.logical_or.reduce([near.any(0) for _, near in parts])
        return pd.DataFrame({"rep": np.concatenate([hid[some], oid[also]]), "links": np.concatenate([links[some], np.zeros(also.sum(), np.int64)]), "root": np.concatenate([low[some], top[also]])}).astype("int64")

    return run


def pick_pivots(classes: DataFrame) -> dict[tuple[str, int], np.ndarray]:
    """Unit pivots by (label, length), the largest groups first, within PIVOT_NUMBERS in all.  classes: label, dim, rep, vec.

    A group's pivots are the first by hash; only rows whose hash is low enough to be
    among them, with room to spare, are put in order.
    """
    least = classes.agg(F.min("dim")).first()[0] or 1
    # two pivots are the least that a group can have
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "label", "dim").limit(PIVOT_NUMBERS // (2 * least)).collect()
    left, wanted = PIVOT_NUMBERS, []
    for r in sizes:
        k = min(r.n, PIVOTS * math.ceil(math.sqrt(r.n / _block(r.dim))), left // r.dim)
        if k < 2:
            break
        left -= k * r.dim
        wanted.append((r.label, r.dim, k, min(1.0, (2 * k + 32) / r.n)))
    if not wanted:
        return {}
    spark = classes.sparkSession
    most = F.broadcast(spark.createDataFrame(wanted, "label string, dim int, k int, share double"))  # within PIVOT_NUMBERS
    hashed = F.pmod(F.xxhash64("rep"), F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))
    narrow = classes.select("label", "dim", "rep").join(most, ["label", "dim"]).where(hashed < F.col("share"))
    order = W.partitionBy("label", "dim").orderBy(F.pmod(F.xxhash64("rep"), F.lit(1 << 53)), "rep")
    picked = narrow.withColumn("i", F.row_number().over(order)).where(F.col("i") <= F.col("k")).select("rep")
    out: dict[tuple[str, int], list[np.ndarray]] = {}
    for r in classes.join(F.broadcast(picked), "rep").select("label", "dim", "rep", "vec").orderBy("rep").collect():  # within PIVOT_NUMBERS
        v = np.asarray(r.vec, np.float64)
        out.setdefault((r.label, r.dim), []).append(v / np.linalg.norm(v))
    return {k: np.stack(v) for k, v in out.items()}


def range_join(spark: SparkSession, vectors: DataFrame, cosine: float = 0.98, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Rows are compared only within one label and one length.  A null label, and a
    vector that is null, empty, zero, or holds a null or a non-finite component,
    links with nothing: 0 links, its own component, kept.  Rows that repeat an id
    count as rows; a null id gives null component and kept.  However large or small
    finite components are, their vectors are compared.  Other columns are not looked
    at.  No rows: an empty result.
    """
    small_batches(spark)
    ws = Workspace(spark, "range")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vec"), F.col(label).cast("string").alias("label"))
    bad = F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    big = F.array_max(F.transform("vec", F.abs))
    fine = F.coalesce(F.col("label").isNotNull() & (F.size("vec") > 0) & ~bad & (big > 0), F.lit(False))
    rows = rows.withColumn("big", F.when(fine, big)).withColumn("vec", F.when((F.col("big") < LOW) | (F.col("big") > HIGH), F.transform("vec", lambda v: v / F.col("big"))).otherwise(F.col("vec")))
    fine = F.col("big").isNotNull()
    rows = rows.select("vec_id", "label", "vec", fine.alias("fine"), F.when(fine, F.xxhash64("label", "vec")).alias("k1"), F.when(fine, F.xxhash64("vec", "label", F.lit(1))).alias("k2"))
    good = rows.where("fine AND vec_id IS NOT NULL")
    classes = ws.write(good.groupBy("k1", "k2").agg(F.first("label").alias("label"), F.first("vec").alias("vec"), F.min("vec_id").alias("name"), F.count("*").alias("mult")).withColumn("rep", F.monotonically_increasing_id()), "classes")
    eps = math.sqrt(2 - 2 * cosine)
    p = pick_pivots(classes.withColumn("dim", F.size("vec")))

    placed = ws.write(classes.select("label", "rep", "mult", "vec").mapInArrow(_cells(p, eps), "label string, rep long, mult long, vec array<double>, cell int, home boolean"), "cells")
    placed = placed.withColumn("dim", F.size("vec"))
    held = placed.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / F.greatest(F.lit(64), F.floor(F.lit(BLOCK_NUMBERS) / F.col("dim")))).cast("int").alias("parts"))
    placed = placed.join(held, ["label", "dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    keys = ["label", "dim", "cell", "i", "j"]
    left = placed.where("home").withColumn("j", F.explode(every)).select("label", "dim", "cell", F.col("part").alias("i"), "j", F.lit(0).alias("side"), "rep", "mult", "vec")
    right = placed.withColumn("i", F.explode(every)).select("label", "dim", "cell", "i", F.col("part").alias("j"), F.lit(1).alias("side"), "rep", "mult", "vec")
    met = ws.write(left.unionByName(right).groupBy(*keys).applyInPandas(_blocks(cosine), "rep long, links long, root long"), "links")

    links = met.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = connected_components(ws, met, "rep", "root").withColumnRenamed("node", "rep")
    linked = ws.write(classes.select("k1", "k2", "name", "rep", "mult").join(links, "rep", "left").join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep")), "linked")
    least = ws.write(linked.groupBy("root").agg(F.min("name").alias("component")), "least")
    by_class = linked.join(least, "root").select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), "component")
    by_class = ws.write(by_class, "named")
    ws.drop_all_but(by_class)
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return rows.select("vec_id", "k1", "k2").join(by_class, ["k1", "k2"], "left").select("vec_id", F.when(F.col("vec_id").isNull(), F.lit(0)).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
