"""Hard negatives by a two-dimensional block matrix multiply (SUMMA).

Anchors and all rows are cut into blocks of rows, and each block into panels of
dimensions.  One task holds the place (i, j) of the grid: the panels of the anchors'
block i are sent along row i, those of the rows' block j along column j, and their
products are added up there, for a strip of anchors at a time.  Scores stay in the
task; neither they nor partial ones are shuffled or stored.  Anchors are the query
set, so anchors times rows is the work.

The grid is gone over twice: the first time for each anchor's best rows of its own
label, the second for the best rows of other labels within each window that a
positive's score opens; both are then reduced over the places of a row of the grid.
Panels meet by grouping and not by a join, as Spark takes a side for as small as it
is before it is sent along, and would then send all copies by way of the driver.

Rows equal in id, label and integer vector are one row with a multiplicity, so copies
of a row cost nothing and cannot fill a block.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.workspace import Workspace, checked_broadcast, small_batches

#: Most anchors and rows of a block, and bytes of its integers; least dimensions of a panel, most panels of a vector, anchors whose scores are held at once.
ANCHORS, ROWS, BYTES, CHUNK, CHUNKS, STRIP = 8192, 16384, 8 << 20, 32, 8, 128
#: Squared length below which all scores, and the window's products with them, fit 64 bits.
MOST = float(1 << 57)
_BLOCK = "side int, dim int, shard int, others int, k int, n int, mat binary, ids array<long>, labels array<string>, mults array<long>, norms array<long>"
_META = ("ids", "labels", "mults", "norms")


def _blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    """One block of rows as panels of dimensions, its rows by id; ids, labels, multiplicities and squared lengths go with the first panel."""
    dim = int(pdf["dim"].iloc[0])
    m = np.array([np.asarray(v, np.int32) for v in pdf["vec"]], np.int32).reshape(len(pdf), dim)
    order = sorted(range(len(pdf)), key=lambda r, i=pdf["vec_id"].to_numpy(), t=pdf["label"].to_numpy(): (i[r], t[r], m[r].tobytes()))
    pdf, m = pdf.iloc[order], m[order]
    meta = {"ids": pdf["vec_id"].to_numpy(), "labels": pdf["label"].to_numpy(), "mults": pdf["mult"].to_numpy(), "norms": (m.astype(np.int64) ** 2).sum(1)}
    step, none = max(CHUNK, math.ceil(dim / CHUNKS)), dict.fromkeys(_META)
    head = {"side": pdf["side"].iloc[0], "dim": dim, "shard": pdf["shard"].iloc[0], "others": pdf["others"].iloc[0], "n": len(pdf)}
    return pd.DataFrame([head | {"k": k, "mat": m[:, at : at + step].tobytes()} | (none if k else meta) for k, at in enumerate(range(0, max(dim, 1), step))])


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed, exact in int64: in doubles where no partial sum leaves their integers."""
    longest = [math.sqrt((x.astype(np.float64) ** 2).sum(1).max(initial=0.0)) for x in (a, b)]
    if longest[0] * longest[1] < 1 << 52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _sides(pdf: pd.DataFrame) -> tuple[list[np.ndarray], dict, list[np.ndarray], dict] | None:
    """Panels and first row of the anchors' and the rows' block at one place; none where a block is empty."""
    out = []
    for side in (0, 1):
        own = pdf[pdf["side"] == side].sort_values("k")
        if own.empty:
            return None
        first = own.iloc[0].to_dict()
        out += [[np.frombuffer(m, np.int32).reshape(first["n"], -1) for m in own["mat"]], first]
    both = pd.factorize(np.concatenate([out[1]["labels"], out[3]["labels"]]))[0]
    out[1]["labels"], out[3]["labels"] = both[: out[1]["n"]], both[out[1]["n"] :]
    return tuple(out)


def _strips(a: list[np.ndarray], b: list[np.ndarray], anchors: np.ndarray, rows: np.ndarray | slice = slice(None)):
    """(anchors, their scores with the rows), a strip at a time, the panels' products added up."""
    b = [q[rows] for q in b]
    for at in range(0, len(anchors), STRIP):
        strip = anchors[at : at + STRIP]
        total = product(a[0][strip], b[0])
        for p, q in zip(a[1:], b[1:]):
            total += product(p[strip], q)
        yield strip, total


def _best(scores: np.ndarray, ids: np.ndarray, mults: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best scores and their ids; ids rise, so equal scores fall by smaller id; a row counts mults times."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above, at = np.flatnonzero(scores > least), np.flatnonzero(scores == least)[:k]
        some = np.concatenate([above, at])
        scores, ids, mults = scores[some], ids[some], mults[some]
    order = np.lexsort((ids, -scores))
    order = np.repeat(order, np.minimum(mults[order], k))[:k]
    return scores[order], ids[order]


_NEAR = "dim int, i int, a int, anchor_id long, anchor_mult long, positive_id long, positive_score long"
_FAR = "dim int, i int, a int, slot int, negative_id long, negative_score long"


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    kinds = {c: {"int": "int32", "long": "int64"}[t] for c, t in (x.split() for x in schema.split(", "))}
    return pd.DataFrame(rows, columns=list(kinds)).astype(kinds)


def _positives(k: int):
    """The k best rows of each anchor's label in each block of rows, without the anchor itself."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        if sides := _sides(pdf):
            a, m, b, n = sides
            for label in np.intersect1d(m["labels"], n["labels"]):
                rows = np.flatnonzero(n["labels"] == label)
                ids, mults, norms = (n[c][rows] for c in ("ids", "mults", "norms"))
                for strip, scores in _strips(a, b, np.flatnonzero(m["labels"] == label), rows):
                    for at, s in zip(strip, scores):
                        # the anchor is no other row; its copies are: equal id and label, and a vector at distance 0
                        left = mults - ((ids == m["ids"][at]) & (s == m["norms"][at]) & (norms == m["norms"][at]))
                        some = left > 0
                        best, found = _best(s[some], ids[some], left[some], k)
                        out += [(m["dim"], m["shard"], at, m["ids"][at], m["mults"][at], i, x) for i, x in zip(found, best)]
        return _frame(out, _NEAR)

    return run


def _negatives(k: int, low: tuple[int, int], high: tuple[int, int]):
    """The k best rows of other labels in each block of rows, for each window of each anchor."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        if (sides := _sides(pdf)) and sides[1]["window_a"] is not None:
            a, m, b, n = sides
            windows: dict[int, list[tuple[int, int, int]]] = {}
            for at, slot, score in zip(*(m[f"window_{c}"].tolist() for c in ("a", "slot", "score"))):
                at_least, at_most = -((-low[0] * score) // low[1]), high[0] * score // high[1]
                if at_least <= at_most:
                    windows.setdefault(at, []).append((slot, at_least, at_most))
            for strip, scores in _strips(a, b, np.array(sorted(windows), np.int64)):
                for at, s in zip(strip, scores):
                    own = windows[at]
                    some = np.flatnonzero((s >= min(x[1] for x in own)) & (s <= max(x[2] for x in own)))
                    some = some[n["labels"][some] != m["labels"][at]]
                    some = some[np.argsort(-s[some], kind="stable")]  # rows of a block rise by id
                    falling = -s[some]
                    for slot, at_least, at_most in own:
                        part = some[np.searchsorted(falling, -at_most, "left") : np.searchsorted(falling, -at_least, "right")][:k]
                        part = np.repeat(part, np.minimum(n["mults"][part], k))[:k]
                        out += [(m["dim"], m["shard"], at, slot, i, x) for i, x in zip(n["ids"][part], s[part])]
        return _frame(out, _FAR)

    return run


def panels(ws: Workspace, classes: DataFrame, every: int) -> tuple[DataFrame, DataFrame]:
    """The panels of the anchors (ids divisible by every) and of all rows that meet an anchor.  classes: vec_id, label, vec, mult."""
    is_anchor = F.col("vec_id") % every == 0
    classes = classes.withColumn("dim", F.size("vec"))

    def blocks(n: str, most: int) -> Column:
        fit = F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.lit(BYTES) / (4 * F.greatest("dim", F.lit(1))))))
        return F.ceil(F.col(n) / fit).cast("int")

    sizes = classes.groupBy("dim").agg(F.count("*").alias("n"), F.count(F.when(is_anchor, 1)).alias("n_anchors")).where("n_anchors > 0")
    sizes = ws.write(sizes.select("dim", blocks("n_anchors", ANCHORS).alias("of_anchors"), blocks("n", ROWS).alias("of_rows")), "sizes")
    classes = classes.join(checked_broadcast(sizes), "dim")

    def side(k: int, t: DataFrame, own: str, others: str, tag: str) -> DataFrame:
        shard = F.pmod(F.xxhash64("vec_id", "label", "vec"), F.col(own)).cast("int")
        rows = t.select(F.lit(k).alias("side"), "dim", shard.alias("shard"), F.col(others).alias("others"), "vec_id", "label", "mult", "vec")
        # small row groups: a reader holds one of them whole
        return ws.write(rows.groupBy("side", "dim", "shard").applyInPandas(_blocks, _BLOCK), tag, **{"parquet.block.size": str(16 << 20)})

    return side(0, classes.where(is_anchor), "of_anchors", "of_rows", "anchors"), side(1, classes, "of_rows", "of_anchors", "rows")


def grid(a: DataFrame, b: DataFrame) -> GroupedData:
    """Both sides' panels, sent along the rows and columns of the grid, by its places."""
    along = F.explode(F.sequence(F.lit(0), F.col("others") - 1))
    a, b = a.withColumns({"i": F.col("shard"), "j": along}), b.withColumns({"j": F.col("shard"), "i": along})
    return a.unionByName(b, allowMissingColumns=True).groupBy("dim", "i", "j")


def hard_negatives(spark: SparkSession, vectors: DataFrame, every: int = 50, scale: int = 256, positives: int = 5, negatives: int = 3, low: tuple[int, int] = (1, 2), high: tuple[int, int] = (19, 20), vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by every.  Components x become
    floor(scale * x); scores are integer inner products of vectors of one length.
    An anchor's positives are its first other rows of the same label, its negatives
    for each of them the first rows of other labels with a score between the
    fractions low and high of the positive's.  Higher scores come first, then
    smaller ids.

    No part take: rows whose id, label or vector is null, vectors that hold a null
    or a non-finite component, and those whose integer form has a squared length of
    2**57 or more, as scores would not fit a long.  Rows that repeat an id count as
    rows: each may be an anchor, and each is another row to the others.  Vectors of
    other lengths are never compared; empty ones score 0 with each other.  Other
    columns are not looked at.  No rows: an empty result.
    """
    small_batches(spark)
    ws = Workspace(spark, "negatives")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("raw")).where("vec_id IS NOT NULL AND label IS NOT NULL AND raw IS NOT NULL")
    fine = ~F.exists("raw", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = rows.where(fine).select("vec_id", "label", F.transform("raw", lambda v: F.floor(F.least(F.greatest(v, F.lit(-1e12)), F.lit(1e12)) * scale)).alias("whole"))
    length = F.aggregate("whole", F.lit(0.0), lambda t, v: t + v.cast("double") * v.cast("double"))
    classes = rows.where(length < MOST).groupBy("vec_id", "label", F.col("whole").cast("array<int>").alias("vec")).agg(F.count("*").alias("mult"))
    a, b = panels(ws, ws.write(classes, "classes"), every)

    first = lambda t, keys, score, name, k, out: t.withColumn(out, F.row_number().over(W.partitionBy("dim", "i", "a", *keys).orderBy(F.col(score).desc(), name))).where(F.col(out) <= k)
    near = ws.write(first(grid(a, b).applyInPandas(_positives(positives), _NEAR), (), "positive_score", "positive_id", positives, "slot"), "positives")
    windows = near.groupBy("dim", F.col("i").alias("shard")).agg(F.collect_list(F.struct("a", "slot", "positive_score")).alias("w"))
    windows = windows.select("dim", "shard", F.lit(0).alias("k"), *(F.col(f"w.{c}").alias(f"window_{n}") for c, n in (("a", "a"), ("slot", "slot"), ("positive_score", "score"))))
    far = grid(a.join(windows.hint("merge"), ["dim", "shard", "k"], "left"), b).applyInPandas(_negatives(negatives, low, high), _FAR)
    far = ws.write(first(far, ("slot",), "negative_score", "negative_id", negatives, "rank"), "negatives")
    ws.drop_all_but(near, far)
    out = near.join(far.hint("merge"), ["dim", "i", "a", "slot"])
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "anchor_mult"))).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def hard_negatives_sql() -> str:
    """The query's rows, each anchor against all rows, for DuckDB."""
    return """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.rid AS aid, a.vec_id AS anchor_id, b.rid AS bid, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.rid <> b.rid AND a.vec_id % 50 = 0 AND len(a.e) = len(b.e)
), p AS (
  SELECT aid, anchor_id, bid, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY aid ORDER BY score DESC, other, bid) <= 5
)
SELECT anchor_id, positive_id, "rank", negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, p.positive_id, p.positive_score, s.other AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.aid, p.bid ORDER BY s.score DESC, s.other)::INT AS "rank"
  FROM p JOIN s ON s.aid = p.aid AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
) WHERE "rank" <= 3"""
