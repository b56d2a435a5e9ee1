"""Sweeps and part joins against every point compared with every range."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import intervals

KEY = ["partition", "video_id"]


def tables(spark, points, ranges):
    p = spark.createDataFrame([("p", v, i, t) for v, i, t in points], "partition string, video_id string, sentence_id long, text string")
    r = spark.createDataFrame([("p", v, n, a, b) for v, n, a, b in ranges], "partition string, video_id string, segment_no long, first long, last long")
    return p, r


def cases():
    r = random.Random(3)
    ids = {"dense": range(1, 60), "sparse": [3, 90, 1_000, 10**9, 10**12], "negative": range(-30, 30), "one": [7], "bare": range(5)}
    points = [(v, i, f"{v}{i}") for v, own in ids.items() for i in own] + [("dense", 5, "again"), ("dense", None, "null"), ("nulls", None, "n")]
    ranges = []
    for v, own in ids.items():
        low, high = min(own), max(own)
        ranges += [(v, n, a := r.randint(low - 5, high), r.randint(a, high + 5)) for n in range(25)] if v != "bare" else []
    ranges += [("dense", 90, 9, 3), ("dense", 91, None, 3), ("dense", 92, 3, None), ("dense", 93, -(10**15), 10**15), ("other", 1, 1, 5), ("one", 94, 7, 7), ("one", 95, 8, 9), ("one", 96, 1, 6)]
    return points, ranges


@pytest.mark.parametrize("width", [1, 3, 1 << 16])
def test_both_equal_brute_force(spark, monkeypatch, width):
    monkeypatch.setattr(intervals, "SWEEP", width)
    monkeypatch.setattr(intervals, "JOIN", width)
    points, ranges = cases()
    p, r = tables(spark, points, ranges)
    met = [(v, i, t, n) for v, i, t in points for u, n, a, b in ranges if v == u and None not in (i, a, b) and a <= i <= b]
    got = [(x.video_id, x.sentence_id, x.text, x.segment_no) for x in intervals.pairs(p, r, KEY, "sentence_id", "first", "last").collect()]
    assert sorted(got) == sorted(met)
    want = collections.Counter((v, i) for v, i, _, _ in met)
    told = {(x.video_id, x.sentence_id): x.covering for x in intervals.counts(p, r, KEY, "sentence_id", "first", "last").collect()}
    assert told == {(v, i): want[v, i] for v, i, _ in points}


def test_empty_tables(spark):
    p, r = tables(spark, *cases())
    for a, b in ((p.limit(0), r), (p, r.limit(0)), (p.limit(0), r.limit(0))):
        assert intervals.pairs(a, b, KEY, "sentence_id", "first", "last").count() == 0
        assert {x.covering for x in intervals.counts(a, b, KEY, "sentence_id", "first", "last").collect()} <= {0}


def test_one_recording_of_a_million_sentences(spark):
    """Each sentence meets the few ranges of its part, and the sweep is cut into parts."""
    n = 1_000_000
    key = [F.lit("p").alias("partition"), F.lit("v").alias("video_id")]
    p = spark.range(1, n + 1, 1, 8).select(*key, F.col("id").alias("sentence_id"))
    r = spark.range(1, n + 1, 20, 4).select(*key, F.col("id").alias("segment_no"), F.col("id").alias("first"), (F.col("id") + F.when(F.col("id") % 1000 == 1, 24).otherwise(19)).alias("last"))
    told = intervals.counts(p, r, KEY, "sentence_id", "first", "last").groupBy("covering").count().collect()
    twice = 5 * (n // 1000 - 1) + 5
    assert {x.covering: x["count"] for x in told} == {1: n - twice, 2: twice}
    assert intervals.pairs(p, r, KEY, "sentence_id", "first", "last").count() == n + twice
