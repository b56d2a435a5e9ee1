"""Jobs as a relation of the store (ST6, ST7, P10, P13, SRC12): a row for each video of a job, from which every state is derived.

The host application runs the work and records what becomes of each item; what
follows for the other items and for the job is a rule over the relation, so any
process may ask, and a restart loses nothing but what was in work.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import jobs
from lectern.sources.store import Store, locked
from lectern.workbench import now

SCHEMA = "job_id string, seq long, stage string, pos int, video_id string, status string, job_status string, log string, updated_at string"


class JobLog:
    def __init__(self, store: Store, clock: Callable[[], str] = now):
        self.store, self.spark, self.clock = store, store.spark, clock

    def items(self, at: dict | None = None) -> DataFrame:
        at = at or self.store.pointer()
        return self.store.table("jobs", at) if "jobs" in at["relations"] else self.spark.createDataFrame([], SCHEMA)

    def _put(self, items: DataFrame, at: dict) -> None:
        """Items of some jobs, all of each, with the rules of a job applied."""
        items = jobs.after_failures(items)
        states = jobs.job_states(items).withColumnRenamed("status", "now")
        stopping = items.groupBy("job_id").agg(F.max(F.col("status") == "cancelling").alias("stopping"), F.max(F.col("status") == "interrupted").alias("broken"))
        state = F.when(F.col("stopping"), "cancelling").when(F.col("broken"), "interrupted").otherwise(F.col("now"))
        put = items.join(states, "job_id").join(stopping, "job_id").withColumns({"job_status": state, "updated_at": F.lit(self.clock())}).select(*(c.split()[0] for c in SCHEMA.split(", ")))
        self.store.commit({"jobs": put}, at["revision"], items.select(F.col("job_id").alias("video_id")).distinct())

    def _of(self, job_id: str, at: dict) -> DataFrame:
        own = self.items(at).where(F.col("job_id") == job_id)
        if own.isEmpty():
            raise KeyError(job_id)
        return own

    @locked
    def create(self, stage: str, video_ids: list[str]) -> str:
        """P10: a queued job over distinct videos in their order; refused without videos, for a stage that is none, and where a video lacks the stage's input."""
        if stage not in jobs.BANDS or not video_ids:
            raise ValueError("a job needs a stage and a video")
        at, distinct = self.store.pointer(), list(dict.fromkeys(video_ids))
        asked = self.spark.createDataFrame([(v, stage) for v in distinct], "id string, stage string")
        part = self.store.narrowed(at, asked.select(F.col("id").alias("video_id")))
        ids = lambda n: self.store.table(n, part).select(F.col("video_id").alias("id")).distinct() if n in part["relations"] else asked.select("id").limit(0)
        if lacking := jobs.missing_inputs(asked, ids("raw"), ids("cleaned")).first():
            raise ValueError(f"{lacking.id} lacks the input of {stage}")
        job_id, seq = uuid.uuid4().hex, (self.items(at).agg(F.max("seq")).first()[0] or 0) + 1
        self._put(self.spark.createDataFrame([(job_id, seq, stage, i, v, "queued", "queued", "", "") for i, v in enumerate(distinct)], SCHEMA), at)
        return job_id

    @locked
    def record(self, job_id: str, pos: int, status: str, log: str = "") -> None:
        """ST5, ST6: what became of an item; later items of a failed one are cancelled, and the log keeps its end."""
        at = self.store.pointer()
        hit = F.col("pos") == pos
        own = self._of(job_id, at).withColumns({"status": F.when(hit, status).otherwise(F.col("status")), "log": F.when(hit, jobs.log_tail(F.col("log"), F.lit(log))).otherwise(F.col("log"))})
        self._put(own, at)

    @locked
    def cancel(self, job_id: str) -> None:
        """ST6: items not begun are cancelled, one in work is asked to stop; ValueError if the job is over."""
        at = self.store.pointer()
        own = self._of(job_id, at)
        if own.where(F.col("job_status").isin(*jobs.LIVE)).isEmpty():
            raise ValueError(f"{job_id} is over")
        self._put(jobs.cancelled(own, own.select("job_id")), at)

    @locked
    def interrupted(self) -> None:
        """SRC12: after a restart, what was live was interrupted."""
        at = self.store.pointer()
        live = self.items(at).where(F.col("job_status").isin(*jobs.LIVE))
        if not live.isEmpty():
            self._put(jobs.restarted(live), at)

    def busy(self, videos: DataFrame, at: dict | None = None) -> DataFrame:
        """Those of some videos (video_id) that a live job works on or will."""
        live = self.items(at).where(F.col("job_status").isin(*jobs.LIVE) & F.col("status").isin(*jobs.LIVE))
        return live.join(videos, "video_id", "left_semi").select("video_id").distinct()
