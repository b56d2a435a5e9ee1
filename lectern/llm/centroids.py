"""Centroid clustering: plain Lloyd in integers.

Each round hands the centroids, which are few, to every task; mapInPandas computes
squared differences to each centroid in NumPy and takes the nearest (ties: the
smaller number), and each partition returns one count and one integer sum a
centroid.  These merge through a groupBy, so what reaches the driver is as small
as the centroids, and the next round's centroids are exact quotients.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.workspace import Workspace, small_batches

#: Integer components beyond this would let a squared distance leave 64 bits.
MOST = 1 << 27


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row, the smallest of equals, and the squared distance, all in int64."""
    far = np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)
    at = far.argmin(1)
    return at, far[np.arange(len(x)), at]


def _matrix(pdf: pd.DataFrame, dim: int) -> np.ndarray:
    return np.array(pdf["vec"].tolist(), np.int64).reshape(-1, dim)


def _sums(centroids: np.ndarray):
    def run(frames):
        n, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for pdf in frames:
            x = _matrix(pdf, centroids.shape[1])
            at, _ = nearest(x, centroids)
            for k in np.unique(at):
                n[k] += (at == k).sum()
                sums[k] += x[at == k].sum(0)
        some = np.flatnonzero(n)
        if len(some):
            yield pd.DataFrame({"cluster": some.astype(np.int32), "n": n[some], "sums": list(sums[some])})

    return run


def _assign(centroids: np.ndarray):
    def run(frames):
        for pdf in frames:
            at, far = nearest(_matrix(pdf, centroids.shape[1]), centroids)
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "cluster": at.astype(np.int32), "distance": far})

    return run


def step(points: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floor(sum / count) of what each was nearest to; empty ones stay."""
    wide = lambda i: F.sum(F.col("sums")[i].cast("decimal(19,0)")).alias(f"s{i}")
    part = points.mapInPandas(_sums(centroids), "cluster int, n long, sums array<long>")
    out = centroids.copy()
    for r in part.groupBy("cluster").agg(F.sum("n").alias("n"), *(wide(i) for i in range(centroids.shape[1]))).collect():  # a row a centroid
        out[r.cluster] = [int(r[f"s{i}"]) // r.n for i in range(centroids.shape[1])]
    return out


def seed_order(vec_id: Column, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), vec_id.cast("string")), 256)


def lloyd(spark: SparkSession, vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every kept vector.

    Kept are vectors of exactly dim components, none null or non-finite; those with
    a component x whose floor(scale * x) is beyond 2**27 are left out too, as their
    distances need not fit a long.  Centroids start as the k kept vectors with the
    smallest SHA-256 of "seed:id"; rows without an id are clustered but start
    nothing, and rows that repeat an id count as rows (as starts in the order of
    their components).  Fewer vectors than k give fewer centroids.  A sum of
    distances that does not fit a long is null.  Other columns are not looked at.
    No vectors: an empty result.
    """
    small_batches(spark)
    ws = Workspace(spark, "lloyd")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vec"))
    fine = (F.size("vec") == dim) & ~F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) > MOST / scale))
    points = ws.write(rows.where(fine).select("vec_id", F.transform("vec", lambda v: F.floor(v * scale).cast("int")).alias("vec")), "points")
    start = points.where("vec_id IS NOT NULL").orderBy(seed_order(F.col("vec_id"), seed), "vec").limit(k).collect()
    if not start:
        assigned = points.select("vec_id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance"))
        return assigned.select("*", *(F.lit(None).cast(t).alias(c) for c, t in (("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))))
    centroids = np.array([r.vec for r in start], np.int64).reshape(len(start), dim)
    for _ in range(rounds):
        centroids = step(points, centroids)
    assigned = ws.write(points.mapInPandas(_assign(centroids), "vec_id long, cluster int, distance long"), "assigned")
    ws.drop_all_but(assigned)
    by = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("own")).collect()  # a row a centroid
    total = sum(int(r.own) for r in by)
    fits = lambda v: int(v) if v < 1 << 63 else None
    told = [(r.cluster, fits(r.own), fits(total), hashlib.sha256(",".join(map(str, centroids[r.cluster].tolist())).encode()).hexdigest()) for r in by]
    about = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row a centroid


def lloyd_sql(k: int = 8, rounds: int = 10) -> str:
    """The query's rows, one pair of tables a round, for DuckDB."""
    out = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS MATERIALIZED (SELECT rid, unnest(e) AS v, generate_subscripts(e, 1) AS i FROM kept),
c0 AS MATERIALIZED (
  SELECT n - 1 AS c, unnest(e) AS v, generate_subscripts(e, 1) AS i
  FROM (SELECT e, row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR)) AS n FROM kept WHERE vec_id IS NOT NULL) WHERE n <= {k}
)"""
    for r in range(rounds + 1):
        out += f""", d{r} AS MATERIALIZED (
  SELECT rid, c, d FROM (SELECT rid, c, sum((x.v - c{r}.v) * (x.v - c{r}.v))::BIGINT AS d FROM x JOIN c{r} USING (i) GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1
)"""
        if r < rounds:
            out += f""", c{r + 1} AS MATERIALIZED (
  SELECT c{r}.c, c{r}.i, coalesce(m.v, c{r}.v) AS v FROM c{r} LEFT JOIN (
    SELECT c, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS v FROM (SELECT c, i, sum(v) AS s, count(*) AS n FROM x JOIN d{r} USING (rid) GROUP BY c, i)
  ) m ON m.c = c{r}.c AND m.i = c{r}.i
)"""
    return out + f"""
SELECT vec_id, d.c::INT AS "cluster", d.d AS distance, sum(d.d) OVER (PARTITION BY d.c)::BIGINT AS cluster_inertia, sum(d.d) OVER ()::BIGINT AS inertia, h.h AS centroid_sha256
FROM d{rounds} d JOIN kept USING (rid) JOIN (SELECT c, sha256(string_agg(v::VARCHAR, ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c) h ON h.c = d.c"""
