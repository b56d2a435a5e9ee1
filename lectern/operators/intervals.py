"""Points and ranges of a recording (J2, J5, A-COV, E1, V3), linear in both however long the recording is.

Counting the ranges over each point is a sweep: starts, points and ends are events in
one order, and a running sum over them counts the open ranges.  The events lie in
parts of bounded width; each part is summed by itself, and what is open at its
border is the sum of the parts before it, which are few.

Finding the ranges themselves is a join on narrow parts: a range stands in each part
that it touches, a point in one, and only these meet.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Places of a part of a sweep, and points of a part of a join.
SWEEP, JOIN = 1 << 16, 1 << 8


def _widths(points: DataFrame, keys: list[str], at: str) -> DataFrame:
    """(keys, _lo, _hi, _width): parts of equal width, as many as hold JOIN points each where points lie evenly."""
    spread = points.where(F.col(at).isNotNull()).groupBy(*keys).agg(F.min(at).alias("_lo"), F.max(at).alias("_hi"), F.count("*").alias("_n"))
    parts = F.ceil(F.col("_n") / JOIN)
    return spread.select(*keys, "_lo", "_hi", F.ceil((F.col("_hi") - F.col("_lo") + 1) / parts).alias("_width"))


def _part(at: Column) -> Column:
    return F.floor((at - F.col("_lo")) / F.col("_width"))


def counts(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, start: str, end: str) -> DataFrame:
    """(keys, at, covering): for each point the number of ranges with start <= point <= end; points of one place are one row that counts each of them.

    Ranges with a null or crossed border hold nothing; points whose place is null are held by nothing.
    """
    event = lambda c, kind, d: F.struct(F.col(c).cast("long").alias("_at"), F.lit(kind).alias("_kind"), F.lit(d).alias("_d"))
    r = ranges.where(F.col(start) <= F.col(end)).select(*keys, F.inline(F.array(event(start, 0, 1), event(end, 2, -1))))
    events = points.select(*keys, F.inline(F.array(event(at, 1, 0)))).unionByName(r).withColumn("_part", F.floor(F.col("_at") / SWEEP))
    by_part = W.partitionBy(*keys, "_part").orderBy("_at", "_kind")  # events of one place and kind are told alike, so the last ones tell their part's sum
    swept = events.withColumn("_open", F.sum("_d").over(by_part))
    inside = swept.where("_kind = 1")
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # as many rows as parts
    carried = swept.groupBy(*keys, "_part").agg(F.max_by("_open", F.struct("_at", "_kind")).alias("_sum")).withColumn("_carry", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    # a part's carry goes to its points by a union: a join would ask for keys that are not null on one side only, and the events would be made for each side
    told = inside.unionByName(carried, allowMissingColumns=True).withColumn("_carry", F.max("_carry").over(W.partitionBy(*keys, "_part"))).where("_kind = 1")
    known = reduce(Column.__and__, (F.col(k).isNotNull() for k in keys))
    told = told.withColumn("_open", F.when(F.col("_at").isNull(), 0).when(known, F.col("_open") + F.col("_carry")))
    return told.groupBy(*keys, F.col("_at").alias(at)).agg(F.sum("_open").alias("covering"))


def pairs(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, start: str, end: str) -> DataFrame:
    """Each point with each range that holds it: the columns of both, keys once.  Other columns of one name are the callers' to rename."""
    widths = _widths(points, keys, at)
    p = points.join(widths, keys).withColumn("_part", _part(F.col(at))).drop("_lo", "_hi", "_width")
    r = ranges.join(widths, keys).withColumns({"_first": F.greatest(start, "_lo"), "_last": F.least(end, "_hi")}).where((F.col("_first") <= F.col("_last")) & (F.col(start) <= F.col(end)))
    r = r.withColumn("_part", F.explode(F.sequence(_part(F.col("_first")), _part(F.col("_last"))))).drop("_lo", "_hi", "_width", "_first", "_last")
    return p.join(r, [*keys, "_part"]).where(F.col(at).between(F.col(start), F.col(end))).drop("_part")
