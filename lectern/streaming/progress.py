"""Progress streams (ST1-ST8): tagged lines in, monotone progress out."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.operators import jobs as J

OUTPUT = "job_id string, item string, stage string, progress long, detail string, log string"
STATE = "progress long, stage string, detail string, log string, last long"
#: Silence after which an item's state ends: a day.
IDLE_MS = 86_400_000


def line_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Log lines as JSON objects (job_id, item, expected_stage, seq, line), a file at a time."""
    return spark.readStream.schema("job_id string, item string, expected_stage string, seq long, line string").json(folder)


def item_progress(lines: DataFrame) -> DataFrame:
    """ST2-ST4 as an aggregation in update mode: the greatest percent of each item so far."""
    return J.accepted(lines).groupBy("job_id", "item").agg(F.max("percent").alias("progress"), F.count("*").alias("events"))


def follow(idle_ms: int | None) -> Callable:
    """ST4-ST6 for one item: progress never falls, the last event tells stage and detail, other lines go to the log's tail.

    Lines of a trigger are taken in the order of their numbers, whatever batches they
    come in; one whose number was seen before is a repeat and changes nothing.  An item
    that has been silent for idle_ms is forgotten: its state goes, and nothing is told.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        progress, stage, detail, log, last = state.get if state.exists else (0, None, "", "", -1)
        lines = pd.concat(list(batches)).drop_duplicates("seq").sort_values("seq")
        for r in lines[lines["seq"] > last].itertuples(index=False):
            last = int(r.seq)
            if r.percent is not None and r.percent == r.percent:
                progress, stage, detail = max(progress, int(r.percent)), r.stage, r.detail
            else:
                log = (log + (r.line or "") + "\n")[-J.LOG_CHARS :]
        state.update((progress, stage, detail, log, last))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([(*key, stage, progress, detail, log)], columns=["job_id", "item", "stage", "progress", "detail", "log"])

    return run


def snapshots(lines: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """The stateful stream of item snapshots; lines of one item carry rising numbers.

    With idle_ms (IDLE_MS for a service) silent items are forgotten, for which Spark
    goes on running empty triggers; without it every item is kept.
    """
    e = J.parsed(F.col("line"))
    ok = e.isNotNull() & (e["stage"] == F.col("expected_stage"))
    x = lines.select("job_id", "item", "seq", "line", F.when(ok, e["stage"]).alias("stage"), F.when(ok, e["detail"]).alias("detail"), F.when(ok, J.banded(e["stage"], e["fraction"])).alias("percent"))
    return x.groupBy("job_id", "item").applyInPandasWithState(follow(idle_ms), OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def publish(df: DataFrame, write: Callable[[DataFrame, int], Any], checkpoint: str, every: str = "500 milliseconds"):
    """ST8, SNK11: hand throttled snapshots to `write`, at most one a trigger."""
    return df.writeStream.outputMode("update").trigger(processingTime=every).option("checkpointLocation", checkpoint).foreachBatch(write).start()
