"""The catalog of recordings and what the dashboard counts, searches and orders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as X

#: Stages in their order.
STAGES = ("asr", "cleanup", "segments")


def all_ids(*tables: DataFrame) -> DataFrame:
    """Distinct ids of the tables."""
    return reduce(DataFrame.unionByName, [t.select("id") for t in tables]).distinct()


def records(raw: DataFrame, cleaned: DataFrame, segments: DataFrame, business: DataFrame, uploads: DataFrame, history: DataFrame, videos: DataFrame) -> DataFrame:
    """C3, P8.  Each table has one row an id:

    raw (title, duration_ms, sentence_count, processed_at), cleaned (title),
    segments (title, review_status, segment_count), business (title, annotation_count),
    uploads (filename, uploaded_at), history and videos (id only).
    """
    def side(t: DataFrame, p: str) -> DataFrame:
        return t.select("id", F.lit(True).alias(f"{p}_has"), *(F.col(c).alias(f"{p}_{c}") for c in t.columns if c != "id"))

    x = all_ids(raw, cleaned, segments, business, uploads, history)
    for t, p in ((raw, "r"), (cleaned, "c"), (segments, "s"), (business, "b"), (uploads, "u"), (history, "h"), (videos, "v")):
        x = x.join(side(t, p), "id", "left")
    has = lambda p: F.col(f"{p}_has").isNotNull()
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    title = X.first_filled(F.col("s_title"), F.col("c_title"), F.col("b_title"), F.col("r_title"), X.upload_title(F.col("u_filename")), F.left("id", F.lit(12)))
    status = F.when(has("s"), X.first_filled(F.col("s_review_status"), F.lit("pending_review"))).otherwise("not_ready")
    return x.select("id", title.alias("title"), has("u").alias("uploaded"), (has("v") | has("u")).alias("has_video"), has("r").alias("has_raw"), has("c").alias("has_cleaned"), has("s").alias("has_segments"), has("b").alias("has_business"), has("h").alias("has_history"), status.alias("review_status"), count("r_duration_ms").alias("duration_ms"), count("r_sentence_count").alias("sentence_count"), count("s_segment_count").alias("segment_count"), count("b_annotation_count").alias("business_annotation_count"), text("r_processed_at").alias("processed_at"), text("u_uploaded_at").alias("uploaded_at"))


def priority() -> Column:
    """0 waits for the first stage, 1 for another one, 2 for review, 3 is done."""
    return F.when(F.col("uploaded") & ~F.col("has_raw"), 0).when(~(F.col("has_raw") & F.col("has_cleaned") & F.col("has_segments")), 1).when(F.col("review_status") != "confirmed", 2).otherwise(3).cast("long")


def ordered(found: DataFrame) -> DataFrame:
    """By priority, newest first (times as text), title, id."""
    return found.orderBy(priority(), F.greatest("uploaded_at", "processed_at").desc(), "title", "id")


def counts(found: DataFrame) -> DataFrame:
    """A-DASH."""
    n = F.count_if
    c = F.col
    return found.agg(F.count("*").alias("videos"), n(c("uploaded") & ~c("has_raw")).alias("uploaded"), n(c("has_raw")).alias("raw"), n(c("has_cleaned")).alias("cleaned"), n(c("has_segments")).alias("segments"), n(c("has_business")).alias("business"), n(c("has_segments") & (c("review_status") != "confirmed")).alias("pending_review"), n(c("review_status") == "confirmed").alias("completed"))


def search(found: DataFrame, query: str) -> DataFrame:
    """Titles that hold the query, case ignored; a blank query keeps all."""
    q = query.strip().lower()
    return found.where(F.contains(F.lower("title"), F.lit(q))) if q else found


def suggestions(changes: DataFrame) -> DataFrame:
    """Pending suggestions with a usable sentence id, in order."""
    return changes.where("status = 'pending_review' AND sentence_id >= 1").withColumn("source", F.lit("current")).orderBy("video_id", "sentence_id")


def todo(found: DataFrame, done: DataFrame) -> DataFrame:
    """What has no output yet."""
    return found.join(done.select("id"), "id", "left_anti")


def blocked(found: DataFrame, stage: str) -> DataFrame:
    """Ids whose output of a stage must not be overwritten.

    found: id, has_cleaned, has_segments, has_history, review_status, revision, manual.
    """
    if stage not in STAGES:
        raise ValueError(f"unknown stage: {stage}")
    later = {"asr": F.col("has_cleaned"), "cleanup": F.col("has_segments") | F.col("has_history"), "segments": (F.col("review_status") == "confirmed") | (F.coalesce("revision", F.lit(0)) > 0) | F.coalesce("manual", F.lit(False))}
    return found.where(later[stage]).select("id")


def video_paths(files: DataFrame, ids: DataFrame) -> DataFrame:
    """SRC6, SRC7: (id, path, n) by the 16 hex digits in the file name; the first in order, and how many there are."""
    tag = files.select("path", F.regexp_extract("path", r"__([0-9a-f]{16})\.[^/.]*$", 1).alias("tag")).where("tag != ''")
    return ids.select("id", F.left("id", F.lit(16)).alias("tag")).join(tag, "tag").groupBy("id").agg(F.min("path").alias("path"), F.count("*").alias("n"))


def detail(ids: DataFrame, **tables: DataFrame) -> DataFrame:
    """SRC16: one row an id with each table's row as a struct, null where there is none."""
    x = ids.select("id")
    for name, t in tables.items():
        x = x.join(t.select("id", F.struct(*(c for c in t.columns if c != "id")).alias(name)), "id", "left")
    return x
