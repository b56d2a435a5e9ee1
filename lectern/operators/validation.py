"""Constraints across stages (V1-V5).  Every check returns rows (partition, video_id, rule, pos, detail); no rows means valid."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import intervals
from lectern.operators.cleanup import full_text
from lectern.operators.segments import KEY

#: Fixed value: milliseconds that the last sentence may end after the recording.
SLACK_MS = 1_000
#: What is known of a video beside its faults: that it has sentences, some that are not blank, segments.
VIDEO, SPOKEN, SEGMENT = "video", "spoken", "segment"


def _faults(rows: DataFrame, pos: Column, checks: list[tuple[str, Column]]) -> DataFrame:
    """One pass: an array of the rules that a row breaks, exploded."""
    hit = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in checks)), lambda r: r.isNotNull())
    return rows.select(*KEY, pos.cast("long").alias("pos"), F.explode(hit).alias("rule")).select(*KEY, "rule", "pos")


def raw_faults(raw: DataFrame, headers: DataFrame) -> DataFrame:
    """V1.  raw: keys, pos (1..), id, start_ms, end_ms, raw_text; headers: keys, id_in_file, duration_ms."""
    w = W.partitionBy(*KEY).orderBy("pos")
    x = raw.withColumn("before", F.coalesce(F.lag("end_ms").over(w), F.lit(-1)))
    rows = _faults(x, F.col("pos"), [("raw.id", ~F.col("id").eqNullSafe(F.col("pos"))), ("raw.times", ~F.coalesce((F.col("start_ms") >= 0) & (F.col("end_ms") > F.col("start_ms")), F.lit(False))), ("raw.overlap", F.col("start_ms") < F.col("before")), ("raw.text", F.col("raw_text").isNull())])
    last = raw.groupBy(*KEY).agg(F.max_by("end_ms", "pos").alias("last_end"))
    h = headers.join(last, KEY, "left")
    late = F.coalesce((F.col("duration_ms") != 0) & (F.col("last_end") > F.col("duration_ms") + SLACK_MS), F.lit(False))
    return rows.unionByName(_faults(h, F.lit(0), [("raw.video", F.col("id_in_file") != F.col("video_id")), ("raw.empty", F.col("last_end").isNull()), ("raw.late", late)]))


def _other_source(rows: DataFrame, named: str, rule: str) -> DataFrame:
    """Documents whose own name of their source is not the video's id; no name counts as an empty one."""
    return _faults(rows, F.lit(0), [(rule, F.coalesce(F.col(named), F.lit("")) != F.col("video_id"))])


def cleaned_faults(raw: DataFrame, cleaned: DataFrame, texts: DataFrame) -> DataFrame:
    """V2, J1.  Rows are compared by position, only where a video has as many cleaned as raw ones; texts: keys, full_text, and source_id where documents carry one."""
    at = lambda df, key: df.withColumn("pos", F.row_number().over(W.partitionBy(*KEY).orderBy(key)))
    n = raw.groupBy(*KEY).agg(F.count("*").alias("n")).join(cleaned.groupBy(*KEY).agg(F.count("*").alias("m")), KEY)
    counts = _faults(n, F.lit(0), [("cleaned.count", F.col("n") != F.col("m"))])
    same = n.where("n = m").select(*KEY)
    both = at(raw, "id").select(*KEY, "pos", "id", "start_ms", "end_ms").join(same, KEY).join(at(cleaned, "sentence_id").select(*KEY, "pos", "sentence_id", F.col("start_ms").alias("c_start"), F.col("end_ms").alias("c_end"), "text"), [*KEY, "pos"])
    rows = _faults(both, F.col("pos"), [("cleaned.anchor", ~(F.col("id").eqNullSafe(F.col("sentence_id")) & F.col("start_ms").eqNullSafe(F.col("c_start")) & F.col("end_ms").eqNullSafe(F.col("c_end")))), ("cleaned.text", F.col("text").isNull())])
    whole = texts.join(same, KEY).join(full_text(cleaned).withColumnRenamed("full_text", "built"), KEY)
    if "source_id" in texts.columns:
        counts = counts.unionByName(_other_source(texts, "source_id", "cleaned.source"))
    return counts.unionByName(rows).unionByName(_faults(whole, F.lit(0), [("cleaned.full_text", ~F.col("full_text").eqNullSafe(F.col("built")))]))


def coverage(cleaned: DataFrame, segments: DataFrame) -> DataFrame:
    """J2, A-COV: for each non-blank sentence the number of segments over it."""
    s = cleaned.where(~X.is_blank(F.col("text"))).select(*KEY, "sentence_id")
    return intervals.counts(s, segments.where("segment_no IS NOT NULL"), KEY, "sentence_id", "start_sentence_id", "end_sentence_id")


def segment_faults(cleaned: DataFrame, segments: DataFrame, check_content: bool = True, headers: DataFrame | None = None) -> DataFrame:
    """V3, J3.  segments: keys, segment_no, anchors, times, content, manual (boolean); headers: keys, id_in_file, where documents carry an id.

    Of a video without speech only the id and whether it has segments at all are judged.
    """
    w = W.partitionBy(*KEY).orderBy("segment_no")
    first = cleaned.select(*KEY, F.col("sentence_id").alias("start_sentence_id"), F.col("start_ms").alias("a_start"))
    last = cleaned.select(*KEY, F.col("sentence_id").alias("end_sentence_id"), F.col("end_ms").alias("a_end"))
    x = segments.withColumn("pos", F.row_number().over(w)).withColumn("before", F.lag("end_sentence_id").over(w)).join(first, [*KEY, "start_sentence_id"], "left").join(last, [*KEY, "end_sentence_id"], "left")
    there = F.col("a_start").isNotNull() & F.col("a_end").isNotNull()
    rows = _faults(x, F.col("pos"), [("segments.no", F.col("segment_no") != F.col("pos")), ("segments.anchor", ~there | (F.col("end_sentence_id") < F.col("start_sentence_id"))), ("segments.order", F.col("start_sentence_id") <= F.col("before")), ("segments.times", there & ~(F.col("start_ms").eqNullSafe(F.col("a_start")) & F.col("end_ms").eqNullSafe(F.col("a_end")))), (SEGMENT, F.lit(True))])
    if check_content:
        rows = rows.unionByName(_content_faults(cleaned, segments))
    covered = coverage(cleaned, segments)
    out = _heard(rows, cleaned, covered).unionByName(_faults(covered, F.col("sentence_id"), [("segments.coverage", F.col("covering") != 1)]))
    return out if headers is None else out.unionByName(_other_source(headers, "id_in_file", "segments.video"))


def _heard(rows: DataFrame, cleaned: DataFrame, covered: DataFrame) -> DataFrame:
    """The faults of segments without those of silent videos, and the videos whose segments are missing or should not be there.

    All that is known of a video meets once under its keys, in narrow rows.  Null keys meet nothing: what has one is
    not silent, and has no segments.
    """
    video = lambda rule, pos: [F.lit(rule).alias("rule"), pos.cast("long").alias("pos")]
    seen = cleaned.select(*KEY).distinct().select(*KEY, *video(VIDEO, F.lit(0)))
    spoken = covered.groupBy(*KEY).agg(*video(SPOKEN, F.count("covering")))
    has = lambda rule: F.max(F.col("rule") == rule).over(W.partitionBy(*KEY))
    told = rows.unionByName(seen).unionByName(spoken).withColumns({"video": has(VIDEO), "spoken": has(SPOKEN), "segments": has(SEGMENT)})
    known = F.col("partition").isNotNull() & F.col("video_id").isNotNull()
    held = F.col("segments") & known
    whole = F.when(F.col("spoken") & ~held, "segments.missing").when(~F.col("spoken") & held, "segments.unspoken")
    silent = F.col("video") & ~F.col("spoken") & known
    rule = F.when(F.col("rule") == VIDEO, whole).when(~F.col("rule").isin(SPOKEN, SEGMENT) & ~silent, F.col("rule"))
    return told.select(*KEY, rule.alias("rule"), "pos").where("rule IS NOT NULL")


def _content_faults(cleaned: DataFrame, segments: DataFrame) -> DataFrame:
    """Segments whose content is not what their sentences give.  Sentences find their segments by ids alone, so texts move once, to be joined; contents stay where they are, and are told by their digests."""
    digest = lambda c: F.unhex(F.sha2(c, 256))
    g = segments.select(*KEY, "segment_no", "start_sentence_id", "end_sentence_id", F.coalesce("manual", F.lit(False)).alias("manual"), digest("content").alias("content"), digest(X.paragraph(F.col("content"))).alias("told"))
    held = intervals.pairs(cleaned.select(*KEY, "sentence_id").distinct(), g, KEY, "sentence_id", "start_sentence_id", "end_sentence_id")
    texts = cleaned.select(*KEY, "sentence_id", F.coalesce("text", F.lit("")).alias("t"), (~X.is_blank(F.col("text"))).alias("spoken"))
    built = held.join(texts, [*KEY, "sentence_id"]).groupBy(*KEY, "segment_no", "content", "told", "manual").agg(F.sort_array(F.collect_list(F.struct("sentence_id", "t", "spoken"))).alias("rows"))
    joined = lambda rows, mark: digest(X.paragraph(F.array_join(F.transform(rows, lambda r: r["t"]), mark)))
    fine = (F.col("told") == joined(F.filter("rows", lambda r: r["spoken"]), "\n")) | (F.col("manual") & (F.col("told") == joined(F.col("rows"), "")))
    return _faults(built, F.col("segment_no"), [("segments.content", ~fine)])


def stage_faults(raw_ids: DataFrame, cleaned_ids: DataFrame, segment_ids: DataFrame) -> DataFrame:
    """V5, P10: videos without a cleaned document, or with one and without segments."""
    x = raw_ids.join(cleaned_ids.select(*KEY, F.lit(True).alias("c")), KEY, "left").join(segment_ids.select(*KEY, F.lit(True).alias("s")), KEY, "left")
    return _faults(x, F.lit(0), [("stage.cleaned", F.col("c").isNull()), ("stage.segments", F.col("c").isNotNull() & F.col("s").isNull())])


def path_faults(documents: DataFrame, files: DataFrame, root: str | None = None) -> DataFrame:
    """V4.  documents: keys, video_path; files: path.  A path that does not begin with a slash lies below root, where one is given."""
    if root is not None:
        below = F.concat(F.lit(root.rstrip("/") + "/"), F.col("video_path"))
        documents = documents.withColumn("video_path", F.when(X.is_blank(F.col("video_path")) | F.startswith("video_path", F.lit("/")), F.col("video_path")).otherwise(below))
    x = documents.join(files.select(F.col("path").alias("video_path"), F.lit(True).alias("there")).distinct(), "video_path", "left")
    empty = X.is_blank(F.col("video_path"))
    return _faults(x, F.lit(0), [("path.empty", empty), ("path.missing", ~empty & F.col("there").isNull())])


def all_faults(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def totals(ids: DataFrame, faults: DataFrame) -> DataFrame:
    """A-VAL: passed, failed, total and the exit code of a run."""
    bad = faults.select(*KEY).distinct().withColumn("bad", F.lit(True))
    n = lambda c: F.count_if(c)
    return ids.join(bad, KEY, "left").agg(n(F.col("bad").isNull()).alias("passed"), n(F.col("bad").isNotNull()).alias("failed"), F.count("*").alias("total")).withColumn("exit_code", F.when(F.col("failed") > 0, 1).otherwise(0).cast("long"))


def raise_on(faults: DataFrame) -> None:
    """One error with the first rules broken."""
    found = faults.limit(20).collect()
    if found:
        raise ValueError("; ".join(f"{r.video_id} {r.rule} {r.pos}" for r in found))
