"""Jobs: request checks, restart, cancellation and progress, as tables of snapshots and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Each stage's band of an item's progress, states that are not over, characters of log kept, jobs listed.
BANDS = {"asr": (5, 70), "cleanup": (72, 85), "segments": (87, 100)}
LIVE = ("queued", "running", "cancelling")
LOG_CHARS, LISTED = 30_000, 20
PREFIX = "PIPELINE_PROGRESS "
EVENT = "stage string, completed double, total double, detail string"


def emitted(stage: Column, completed: Column, total: Column, detail: Column) -> Column:
    """ST1: an event line: total at least 1, completed within it, detail on one line of at most 160 characters."""
    most = F.greatest(total.cast("double"), F.lit(1.0))
    words = F.left(F.trim(F.regexp_replace(F.coalesce(detail, F.lit("")), r"(?U)\s+", " ")), F.lit(160))
    return F.concat(F.lit(PREFIX), F.to_json(F.struct(stage.alias("stage"), F.greatest(F.lit(0.0), F.least(completed.cast("double"), most)).alias("completed"), most.alias("total"), words.alias("detail"))))


def parsed(line: Column) -> Column:
    """ST2: struct(stage, fraction, detail) of an event line, null for any other line and for malformed events."""
    e = F.from_json(F.substring(line, F.lit(len(PREFIX) + 1), F.length(line)), EVENT)
    ok = line.startswith(PREFIX) & e["stage"].isNotNull() & e["completed"].isNotNull() & (e["total"] > 0)
    return F.when(ok, F.struct(e["stage"].alias("stage"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), e["completed"] / e["total"])).alias("fraction"), F.trim(F.coalesce(e["detail"], F.lit(""))).alias("detail")))


def banded(stage: Column, fraction: Column) -> Column:
    """ST3: an item's percent within its stage's band, halves to even; null for an unknown stage."""
    out = F.lit(None).cast("long")
    for name, (lo, hi) in BANDS.items():
        out = F.when(stage == name, (F.lit(lo) + F.rint(F.lit(float(hi - lo)) * fraction)).cast("long")).otherwise(out)
    return out


def accepted(events: DataFrame) -> DataFrame:
    """ST3: events (.., expected_stage, line) of the expected stage, with fraction, detail and percent; those of a stage without a band are none."""
    x = events.withColumn("e", parsed(F.col("line"))).where("e IS NOT NULL AND e.stage = expected_stage")
    return x.withColumns({"stage": F.col("e.stage"), "fraction": F.col("e.fraction"), "detail": F.col("e.detail"), "percent": banded(F.col("e.stage"), F.col("e.fraction"))}).drop("e").where("percent IS NOT NULL")


def running_max(events: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Progress that never falls."""
    return events.withColumn("progress", F.max(value).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))


def job_progress(items: DataFrame) -> DataFrame:
    """A-PROG: per job (job_id, pos, n_items, progress) of the item in work: items before it count whole; halves to even."""
    return items.withColumn("job_progress", F.rint((F.col("pos") * 100 + F.col("progress")) / F.col("n_items")).cast("long"))


def latest(jobs: DataFrame, most: int = LISTED) -> DataFrame:
    """The newest jobs by their sequence number."""
    return jobs.orderBy(F.col("seq").desc()).limit(most)


def restarted(jobs: DataFrame) -> DataFrame:
    """SRC12: live snapshots were interrupted by the restart."""
    return jobs.withColumn("status", F.when(F.col("status").isin(*LIVE), "interrupted").otherwise(F.col("status")))


def cancelled(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """ST6: asked to stop: queued jobs are cancelled, running ones are cancelling, finished ones stay."""
    x = jobs.join(ids.select("job_id").distinct().withColumn("hit", F.lit(True)), "job_id", "left")
    to = F.when(F.col("hit") & (F.col("status") == "queued"), "cancelled").when(F.col("hit") & (F.col("status") == "running"), "cancelling").otherwise(F.col("status"))
    return x.withColumn("status", to).select(jobs.columns)


def after_failures(items: DataFrame) -> DataFrame:
    """ST6: within a job (job_id, pos, status) items after the first failed one are cancelled."""
    first = F.min(F.when(F.col("status") == "failed", F.col("pos"))).over(W.partitionBy("job_id"))
    return items.withColumn("status", F.when(F.col("pos") > first, "cancelled").otherwise(F.col("status")))


def job_states(items: DataFrame) -> DataFrame:
    """ST6: a job's state by its items."""
    n = lambda s: F.count_if(F.col("status") == s)
    state = F.when(n("running") > 0, "running").when(n("failed") > 0, "failed").when(n("queued") == F.count("*"), "queued").when(n("queued") > 0, "running").when(n("cancelled") > 0, "cancelled").otherwise("completed")
    return items.groupBy("job_id").agg(state.alias("status"))


def busy(items: DataFrame, video_id: str | None = None) -> bool:
    """Whether any item, or one of the video, is in a live job."""
    x = items.where(F.col("job_status").isin(*LIVE))
    return not (x.where(F.col("video_id") == video_id) if video_id else x).isEmpty()


def log_tail(log: Column, new: Column) -> Column:
    """ST5: the end of a log after new text."""
    return F.right(F.concat(F.coalesce(log, F.lit("")), F.coalesce(new, F.lit(""))), F.lit(LOG_CHARS))


def missing_inputs(requests: DataFrame, raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """P10: (id, stage) requests whose stage lacks its input: raw sentences for both stages, cleaned ones for segments too."""
    x = requests.join(raw.select("id", F.lit(True).alias("r")), "id", "left").join(cleaned.select("id", F.lit(True).alias("c")), "id", "left")
    lacks = F.col("stage").isin("cleanup", "segments") & F.col("r").isNull() | (F.col("stage") == "segments") & F.col("c").isNull()
    return x.where(lacks).select("id", "stage")


def run_estimates(samples: DataFrame, runs: DataFrame) -> DataFrame:
    """(video_id, sampled_seconds, estimated_seconds) of recordings of which some ranges were run for trial.

    samples: video_id, start_ms, end_ms, each range once however often it is named;
    runs: video_id, elapsed_seconds, init_ms (what models took to load), duration_seconds.
    What is not loading grows with the length, and less than a second of samples
    counts as one; a recording without samples is extrapolated from that second.
    """
    once = samples.select("video_id", "start_ms", "end_ms").distinct().groupBy("video_id").agg((F.sum(F.col("end_ms") - F.col("start_ms")) / 1000).alias("sampled"))
    x = runs.join(once, "video_id", "left").withColumn("sampled", F.coalesce("sampled", F.lit(0.0)))
    loading = F.coalesce("init_ms", F.lit(0)) / 1000
    whole = loading + F.greatest(F.lit(0.0), F.col("elapsed_seconds") - loading) * F.col("duration_seconds") / F.greatest(F.col("sampled"), F.lit(1.0))
    return x.select("video_id", F.round("sampled", 3).alias("sampled_seconds"), F.round(whole, 1).alias("estimated_seconds"))


def usage(requests: DataFrame) -> DataFrame:
    """A-USE: tokens of model requests by video."""
    return requests.groupBy("video_id").agg(*(F.sum(c).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")), F.count("*").alias("requests"))


def run_counters(results: DataFrame) -> DataFrame:
    """A-RUN: written, skipped and failed videos of a run, and the segments of the written ones; results: video_id, outcome (written, skipped, failed), segments."""
    n = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    return results.agg(n("written"), n("skipped"), n("failed"), F.count("*").alias("videos"), F.coalesce(F.sum(F.when(F.col("outcome") == "written", F.col("segments"))), F.lit(0)).alias("segments"))
