"""Queries around model answers, sequence matching and streams (A2-A9, R1, R8, G1, ST4).

Most have no SQL twin; the tests hold them against brute force and invariants.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import diffs
from lectern.operators import alignment, cleanup, glossary, jobs, responder, segments
from lectern.plans import relations as R
from lectern.plans.registry import query
from lectern.streaming import progress

KEY = R.KEY


@query()
def a6_similarity(spark, d):
    """Every sentence against the one before it."""
    w = W.partitionBy(*KEY).orderBy("id")
    x = R.raw(spark, d).withColumn("before", F.lag("raw_text").over(w))
    return x.select("video_id", "id", diffs.text_similarity(F.col("raw_text"), F.coalesce("before", F.lit(""))).alias("similarity"))


@query()
def a7_drift(spark, d):
    """Proposals shifted by one sentence in part of the videos, as runs."""
    w = W.partitionBy(*KEY).orderBy("id")
    late = F.coalesce(F.lead("raw_text").over(w), F.col("raw_text"))
    x = R.raw(spark, d).select(*KEY, "id", "raw_text", F.lit(0).alias("batch"), F.when(F.ascii("video_id") % 2 == 0, late).otherwise(F.col("raw_text")).alias("text"))
    return cleanup.drift_runs(cleanup.drift_offsets(x)).select("video_id", "id", F.col("offset").alias("offset_"), "run")


@query()
def a8_edit_script(spark, d):
    x = cleanup.changes(R.decided(spark, d))
    return x.select("video_id", "id", F.posexplode(diffs.edit_script(F.col("raw_text"), F.col("proposed_text"))).alias("no", "e")).select("video_id", "id", "no", "e.operation", "e.before", "e.after")


@query()
def a9_redistribute(spark, d):
    """Each chapter's content, its e's doubled, cut over its sentences."""
    g = R.numbered(spark, d).groupBy(*KEY, "segment_no").agg(F.transform(F.sort_array(F.collect_list(F.struct("sentence_id", "text"))), lambda s: s["text"]).alias("parts"))
    new = F.replace(F.array_join("parts", ""), F.lit("e"), F.lit("ee"))
    return g.select("video_id", "segment_no", F.posexplode(diffs.redistributed(F.col("parts"), new)).alias("no", "text"))


@query()
def g1_term_candidates(spark, d):
    x = R.decided(spark, d)
    edited = F.replace(F.replace("proposed_text", F.lit("que"), F.lit("Que-X")), F.lit("th"), F.lit("TH"))
    return x.select("video_id", "id", F.explode(diffs.term_candidates(F.col("proposed_text"), edited)).alias("t")).select("video_id", "id", "t.term", F.array_join("t.aliases", "|").alias("aliases"), "t.original", "t.change_type")


@query()
def x6_terms_lateral(spark, d):
    """The same edits from SQL, with the table function beside each row."""
    diffs.register(spark)
    edited = F.replace(F.replace("proposed_text", F.lit("que"), F.lit("Que-X")), F.lit("th"), F.lit("TH"))
    x = R.decided(spark, d).select("video_id", "id", "proposed_text", edited.alias("edited"))
    return spark.sql("SELECT x.video_id, x.id, t.no, t.term, array_join(t.aliases, '|') AS aliases, t.original, t.change_type FROM {x} x, LATERAL terms_of(x.proposed_text, x.edited) t", x=x)


@query()
def x6_redistributed_rows(spark, d):
    """Each chapter's content, its e's doubled, cut over its sentences, with a chapter as a group of rows."""
    s = R.numbered(spark, d).select("video_id", "segment_no", "sentence_id", "text")
    new = s.groupBy("video_id", "segment_no").agg(F.replace(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sentence_id", "text"))), lambda r: r["text"]), ""), F.lit("e"), F.lit("ee")).alias("new"))
    return diffs.redistributed_rows(s.join(new, ["video_id", "segment_no"]), ["video_id", "segment_no"], "sentence_id", "text", "new")


@query()
def a1_sentences(spark, d):
    """All texts; null where one has no sentence or an open end."""
    x = R.table(spark, d, "conversations")
    return x.select("conv_id", "turn", F.array_join(alignment.complete_sentences(F.coalesce("text", F.lit(""))), "|").alias("sentences"))


def _units(spark, d):
    """Transcripts with a unit a word; a word takes 0.1 s, and every seventh one starts 15 ms early."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    unit = F.transform(words, lambda w, i: F.struct(w.alias("text"), F.greatest(F.lit(0.0), i * 0.1 - F.when(i % 7 == 0, 0.015).otherwise(0.0)).alias("start"), (i * 0.1 + 0.1).alias("end")))
    return R.table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("video_id"), "text", F.lit(0).alias("offset_ms"), unit.alias("units"))


@query()
def a2_align(spark, d):
    return alignment.align(_units(spark, d))


@query()
def a3_split_long(spark, d):
    """Documents with their full stops taken out, so that clause marks have to do."""
    x = R.table(spark, d, "documents").withColumn("text", F.replace("text", F.lit("."), F.lit(",")))
    return x.select("doc_id", F.md5(alignment.normalised(F.col("text"))).alias("normalised"))


def _answers(spark, d):
    """Model answers with faults: rows repeated, fields gone, types wrong, by the sentence's length."""
    r = R.raw(spark, d)
    n = F.length("raw_text")
    text = F.substring(F.to_json(F.array("raw_text")), F.lit(2), F.length(F.to_json(F.array("raw_text"))) - 2)
    row = F.concat(F.lit('{"sentence_id":'), F.when(n % 11 == 0, '"x"').otherwise(F.col("id").cast("string")), F.when(n % 7 != 1, F.concat(F.lit(',"text":'), text)).otherwise(""), F.lit(',"needs_review":'), F.when(n % 5 == 2, '"no"').otherwise("false"), F.lit(',"review_reason":"'), F.when(n % 13 == 3, "why").otherwise(""), F.lit('"}'))
    rows = F.array_repeat(row, F.when(n % 17 == 5, 2).when(n % 17 == 6, 3).otherwise(1))
    g = r.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("id", rows.alias("rows")))).alias("x"))
    return g.select(*KEY, F.lit(0).cast("long").alias("batch"), F.transform("x", lambda s: s["id"]).alias("expected"), F.concat(F.lit('{"results":['), F.array_join(F.flatten(F.transform("x", lambda s: s["rows"])), ","), F.lit("]}")).alias("answer"))


@query()
def r1_response_partial(spark, d):
    return cleanup.judged(_answers(spark, d)).select("video_id", "id", "needs_review", "review_reason", "error", F.md5("text").alias("text"))


@query()
def v7_first_error(spark, d):
    return cleanup.first_error(cleanup.judged(_answers(spark, d))).select("video_id", "id", "error")


@query(f"WITH {R.RAW}, c AS (SELECT *, CASE WHEN length(raw_text) % 17 = 5 THEN 2 WHEN length(raw_text) % 17 = 6 THEN 3 ELSE 1 END AS n FROM raw) SELECT video_id, id, n % 2 = 1 AS accepted, CASE WHEN n % 2 = 1 THEN raw_text END AS text FROM c")
def r1_copies(spark, d):
    n = F.length("raw_text") % 17
    x = R.raw(spark, d).select(*KEY, F.lit(0).alias("batch"), "id", F.col("raw_text").alias("text"), F.posexplode(F.array_repeat(F.lit(1), F.when(n == 5, 2).when(n == 6, 3).otherwise(1))).alias("pos", "one"))
    return cleanup.copies_verdict(x).select("video_id", "id", "accepted", "text")


@query(f"WITH {R.DECIDED} SELECT video_id, id, proposed_text AS proposed, asks AS needs_review FROM decided")
def r8_cleanup(spark, d):
    """The whole cleanup with the deterministic responder: without faults it must equal the plain rule."""
    return responder.clean_videos(R.raw(spark, d), responder.echo).select("video_id", "id", "proposed", "needs_review")


@query(f"WITH RECURSIVE {R.CHAPTERS} SELECT video_id, segment_no, start_sentence_id, end_sentence_id FROM chapters")
def r9_segment_plan(spark, d):
    """Boundaries, ranges, labels and their join, checked before they are used."""
    s = segments.nonblank(R.cleaned(spark, d))
    starts = segments.greedy_starts(s, R.CHAPTER)
    g = segments.materialise(segments.ranges(s, starts))
    return segments.materialise(segments.ranges(s, starts), segments.stand_in_labels(g)).select("video_id", "segment_no", "start_sentence_id", "end_sentence_id")


@query("WITH w AS (SELECT user_id::VARCHAR AS video_id, event_type AS term, list(DISTINCT (event_id % 3)::VARCHAR) AS a FROM events WHERE event_type IN ('view', 'click', 'error') GROUP BY ALL), v AS (SELECT user_id::VARCHAR AS video_id, event_type AS term FROM events WHERE event_type IN ('view', 'signup') GROUP BY ALL) SELECT coalesce(w.video_id, v.video_id) AS video_id, coalesce(w.term, v.term) AS term, array_to_string(list_concat(list_sort(coalesce(a, [])), CASE WHEN v.term IS NOT NULL THEN ['9'] ELSE [] END), '|') AS aliases FROM w FULL JOIN v ON w.video_id = v.video_id AND w.term = v.term")
def j18_merged_candidates(spark, d):
    e = R.table(spark, d, "events").select(F.col("user_id").cast("string").alias("video_id"), F.col("event_type").alias("term"), (F.col("event_id") % 3).cast("string").alias("a"))
    left = e.where(F.col("term").isin("view", "click", "error")).groupBy("video_id", "term").agg(F.array_sort(F.collect_set("a")).alias("aliases"))
    right = e.where(F.col("term").isin("view", "signup")).select("video_id", "term").distinct().withColumn("aliases", F.array(F.lit("9")))
    return glossary.merged_candidates(left, right).select("video_id", "term", F.array_join("aliases", "|").alias("aliases"))


@query("WITH d AS (SELECT doc_id, md5(text) AS f FROM documents), c AS (SELECT f, min(doc_id) AS first FROM d GROUP BY f HAVING min(doc_id) % 2 = 0) SELECT doc_id, 'said ' || first AS raw_transcription FROM d LEFT JOIN c USING (f)")
def snk13_resume(spark, d):
    """Clips by their place in the tree of fingerprints, half of the contents transcribed before under the same settings."""
    content = R.table(spark, d, "documents").select("doc_id", F.md5("text").alias("content"))
    clips = content.select("doc_id", alignment.fingerprint(F.col("content"), {"model": "m", "language": None}).alias("fingerprint"))
    seen = clips.groupBy("fingerprint").agg(F.min("doc_id").alias("first")).where("first % 2 = 0").select("fingerprint", F.concat(F.lit("said "), F.col("first").cast("string")).alias("raw_transcription"), F.lit("English").alias("language"))
    return alignment.resumable(clips, seen).select("doc_id", "raw_transcription")


@query("""WITH s AS (SELECT DISTINCT user_id, event_id % 5 AS a, event_id % 5 + 1 + event_id % 3 AS b FROM events), t AS (SELECT user_id, sum(b - a)::DOUBLE AS sampled FROM s GROUP BY user_id),
r AS (SELECT user_id, count(*)::DOUBLE AS elapsed, min(event_id % 7) * 0.1::DOUBLE AS loading, max(event_id)::DOUBLE AS duration FROM events GROUP BY user_id)
SELECT user_id::VARCHAR AS video_id, round(sampled, 3) AS sampled_seconds, round(loading + greatest(0.0::DOUBLE, elapsed - loading) * duration / greatest(sampled, 1.0::DOUBLE), 1) AS estimated_seconds FROM r JOIN t USING (user_id)""")
def r14_run_estimate(spark, d):
    """A user's events as a recording of which a few ranges were run for trial."""
    e = R.table(spark, d, "events").withColumn("video_id", F.col("user_id").cast("string"))
    start = F.col("event_id") % 5
    samples = e.select("video_id", (start * 1000).alias("start_ms"), ((start + 1 + F.col("event_id") % 3) * 1000).alias("end_ms"))
    runs = e.groupBy("video_id").agg(F.count("*").cast("double").alias("elapsed_seconds"), (F.min(F.col("event_id") % 7) * 100).alias("init_ms"), F.max("event_id").cast("double").alias("duration_seconds"))
    return jobs.run_estimates(samples, runs)


_FRACTION = "greatest(0.0, least(value, 100.0)) / 100.0"


@query(f"SELECT user_id::VARCHAR AS item, max(CASE event_type WHEN 'view' THEN 5 + round_even(65.0 * {_FRACTION}, 0) WHEN 'click' THEN 72 + round_even(13.0 * {_FRACTION}, 0) ELSE 87 + round_even(13.0 * {_FRACTION}, 0) END)::BIGINT AS progress FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY ALL")
def st4_item_progress(spark, d):
    """The stateless half of the progress stream, over the events at rest; the stream itself is run by the tests."""
    from lectern.plans.queries_text import progress_lines

    x = progress_lines(spark, d).select(F.lit("j").alias("job_id"), F.col("user_id").cast("string").alias("item"), "expected_stage", F.col("event_id").alias("seq"), "line")
    return progress.item_progress(x).select("item", "progress")
