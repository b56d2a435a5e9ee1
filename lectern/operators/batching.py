"""Greedy batching (W6, W7, W11).  A batch's start depends on all batches before it, so this is a fold, not a window sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def batch_starts(sizes: Column, most_items: int, most_size: int) -> Column:
    """For an array of sizes, the 0-based places where batches begin: a batch closes before an item that would exceed a limit; an oversized item is alone.

    The fold appends once a batch, not once an item.
    """
    start = F.struct(F.array().cast("array<int>").alias("b"), F.lit(0).alias("i"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("c"))

    def step(a: Column, x: Column) -> Column:
        opens = (a["i"] == 0) | (a["n"] >= most_items) | (a["c"] + x > most_size)
        return F.struct(F.when(opens, F.concat(a["b"], F.array(a["i"]))).otherwise(a["b"]).alias("b"), (a["i"] + 1).alias("i"), F.when(opens, 1).otherwise(a["n"] + 1).alias("n"), F.when(opens, x).otherwise(a["c"] + x).alias("c"))

    return F.aggregate(F.transform(sizes, lambda x: x.cast("long")), start, step, lambda a: a["b"])


def batch_numbers(sizes: Column, most_items: int, most_size: int) -> Column:
    """For an array of sizes, the 0-based batch of each."""
    ends = F.concat(batch_starts(sizes, most_items, most_size), F.array(F.size(sizes)))
    spread = lambda e: F.flatten(F.transform(F.slice(e, 1, F.size(e) - 1), lambda at, k: F.array_repeat(k, F.get(e, k + 1) - at)))
    return F.element_at(F.transform(F.array(ends), spread), 1)  # the fold is bound to a name first, else each element repeats it


def greedy_batches(rows: DataFrame, keys: list[str], order: str, size: str, most_items: int, most_size: int, out: str = "batch") -> DataFrame:
    """rows with the batch number of each within its keys, in order.  One row a group carries the fold: groups are recordings, which are bounded."""
    others = [c for c in rows.columns if c not in keys]
    packed = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, *(c for c in others if c != order)))).alias("rows"))
    numbered = packed.withColumn("at", batch_numbers(F.transform("rows", lambda r: F.coalesce(r[size], F.lit(0))), most_items, most_size))
    flat = numbered.select(*keys, F.explode(F.arrays_zip("rows", "at")).alias("x"))
    return flat.select(*keys, *(F.col(f"x.rows.{c}").alias(c) for c in others), F.col("x.at").cast("long").alias(out))


def recovery_windows(rows: DataFrame, keys: list[str], order: str, width: int = 5) -> DataFrame:
    """Rows in sub-windows of `width` within a batch, by position."""
    from pyspark.sql import Window as W

    at = F.row_number().over(W.partitionBy(*keys).orderBy(order))
    return rows.withColumn("window", F.floor((at - 1) / width))


def circuit_open(failed: Column, limit: int = 2) -> Column:
    """For an array of window failures in order, the 0-based window from which on nothing is tried: after `limit` failures in a row; null if never."""
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("at"))
    return F.aggregate(failed, start, lambda a, x: F.struct(F.when(x, a["run"] + 1).otherwise(0).alias("run"), (a["i"] + 1).alias("i"), F.coalesce(a["at"], F.when(x & (a["run"] + 1 >= limit), a["i"] + 1)).alias("at")), lambda a: a["at"])
