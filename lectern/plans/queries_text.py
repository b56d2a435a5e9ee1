"""Scalar text queries (T, A4, A5, R2, R5, R13, G3, G4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import alignment, cleanup, jobs
from lectern.plans import relations as R
from lectern.plans.registry import query


def _turns(spark, d):
    return R.table(spark, d, "conversations")


@query(f"SELECT conv_id, turn, {R.sql_effective('text')}::BIGINT AS n FROM conversations")
def t1_effective_chars(spark, d):
    return _turns(spark, d).select("conv_id", "turn", X.effective_length(F.col("text")).alias("n"))


@query(f"SELECT conv_id, turn, {R.sql_paragraph('text')} AS paragraph FROM conversations")
def t2_paragraph_text(spark, d):
    return _turns(spark, d).select("conv_id", "turn", X.paragraph(F.col("text")).alias("paragraph"))


@query(f"WITH {R.RAW} SELECT video_id, id, {R.sql_timecode('start_ms')} AS starts, {R.sql_timecode('end_ms * 60')} AS late, {R.sql_timecode('end_ms - start_ms')} AS lasts FROM raw")
def t3_timecode(spark, d):
    return R.raw(spark, d).select("video_id", "id", X.timecode(F.col("start_ms")).alias("starts"), X.timecode(F.col("end_ms") * 60).alias("late"), X.duration(F.col("start_ms"), F.col("end_ms")).alias("lasts"))


@query(f"SELECT conv_id, turn, {R.sql_strip("regexp_replace(replace(coalesce(text, ''), chr(13), ' '), '[' || chr(10) || chr(11) || chr(12) || chr(28) || '-' || chr(30) || chr(133) || chr(8232) || chr(8233) || ']', ' ', 'g')")} AS flat FROM conversations")
def t5_inline(spark, d):
    return _turns(spark, d).select("conv_id", "turn", X.inline(F.col("text")).alias("flat"))


_NAME = "regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1)"
_STEM = f"regexp_replace({_NAME}, '(?s)^(.+)\\.[^./]+$', '\\1')"


@query(f"SELECT page_id, {_STEM} AS plain, {_NAME} AS tagged FROM pages")
def t9_title_from_url(spark, d):
    tagged = F.concat(F.lit("v/"), X.base_name(F.col("url")), F.lit("__"), F.left(F.md5("url"), F.lit(16)), F.lit(".mp4"))
    return R.table(spark, d, "pages").select("page_id", X.title_from_filename(F.col("url")).alias("plain"), X.title_from_filename(tagged).alias("tagged"))


@query(f"SELECT page_id, {_STEM} AS title, left(md5(url), 16) AS bare FROM pages")
def t10_upload_title(spark, d):
    h = F.left(F.md5("url"), F.lit(16))
    return R.table(spark, d, "pages").select("page_id", X.upload_title(F.col("url")).alias("title"), X.upload_title(F.concat(h, F.lit(".mp4"))).alias("bare"))


@query(f"SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace({_NAME}, '[<>:\"/\\\\|?*\\x00-\\x1f]', '_', 'g'), '[. ]+$', ''), ''), 'video.mp4') AS name FROM pages")
def t11_safe_filename(spark, d):
    return R.table(spark, d, "pages").select("page_id", X.safe_filename(F.col("url")).alias("name"))


@query(f"SELECT conv_id, turn, coalesce(nullif(left({R.sql_collapse('text')}, 240), ''), 'model response could not be used') AS error FROM conversations")
def t13_short_error(spark, d):
    return _turns(spark, d).select("conv_id", "turn", X.short_error(F.col("text")).alias("error"))


@query("SELECT conv_id, turn, array_to_string(regexp_extract_all(text, '[㐀-鿿A-Za-z0-9·_-]+'), '|') AS parts FROM conversations")
def t16_term_parts(spark, d):
    return _turns(spark, d).select("conv_id", "turn", F.array_join(X.term_parts(F.col("text")), "|").alias("parts"))


@query(f"WITH k AS (SELECT conv_id, turn, list_filter(list_transform(string_split_regex(text, '[,，、;；]+'), lambda x: {R.sql_strip('x')}), lambda x: x <> '' AND x <> '无') AS w FROM conversations) SELECT conv_id, turn, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), '|') AS words FROM k")
def t17_manual_keywords(spark, d):
    return _turns(spark, d).select("conv_id", "turn", F.array_join(X.keywords(F.col("text")), "|").alias("words"))


@query(f"WITH {R.RAW} SELECT video_id, id, least(100.0, greatest(0.0, start_ms * 100.0::DOUBLE / max(end_ms) OVER (PARTITION BY video_id)))::DOUBLE AS position FROM raw")
def t18_dot_position(spark, d):
    from pyspark.sql import Window as W

    return R.raw(spark, d).select("video_id", "id", X.dot_position(F.col("start_ms"), F.max("end_ms").over(W.partitionBy("video_id"))).alias("position"))


@query("SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'approved' WHEN toxic = 1 THEN 'rejected' ELSE 'applied provisionally' END AS label FROM labels")
def t21_suggestion_label(spark, d):
    decision = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "approved").when(F.col("toxic") == 1, "rejected").otherwise("auto_approved")
    return R.table(spark, d, "labels").select("doc_id", X.suggestion_label(decision).alias("label"))


@query("SELECT event_id, coalesce(nullif(CASE WHEN event_type = 'view' THEN '' ELSE event_type END, ''), nullif(props, ''), 'none') AS revision FROM events")
def t22_first_filled(spark, d):
    return R.table(spark, d, "events").select("event_id", X.first_filled(F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")), F.col("props"), F.lit("none")).alias("revision"))


@query("SELECT conv_id, turn, lower(regexp_replace(text, '[^\\p{L}\\p{N}㐀-鿿]', '', 'g')) AS k FROM conversations")
def a4_alignment_key(spark, d):
    return _turns(spark, d).select("conv_id", "turn", X.alignment_key(F.col("text")).alias("k"))


@query("SELECT conv_id, turn, regexp_replace(regexp_replace(text, '\\.(\\s|$)', '. \\1', 'g'), '([。！？!?]+)', '\\1 ', 'g') AS safe FROM conversations")
def a5_aligner_text(spark, d):
    return _turns(spark, d).select("conv_id", "turn", X.aligner_text(F.col("text")).alias("safe"))


@query("SELECT conv_id, turn, regexp_matches(lower(sha256(conv_id::VARCHAR)), '^[0-9a-f]{64}$') AS good, false AS cut FROM conversations")
def v13_valid_id(spark, d):
    i = F.sha2(F.col("conv_id").cast("string"), 256)
    return _turns(spark, d).select("conv_id", "turn", X.valid_id(F.upper(i)).alias("good"), X.valid_id(F.left(i, F.lit(63))).alias("cut"))


@query("SELECT event_id, CASE WHEN event_id % 7 IN (0, 1, 2, 5) THEN props END AS object FROM events")
def r2_json_object(spark, d):
    """Bare, fenced, fenced with text behind, behind other words, closed but not opened, fenced without a closing fence, fenced on one line."""
    kinds = ["{}", "```json\n{}\n```", "\n```\n{}\n``` and more", "sorry: {}", "{}\n```", "```json\n{}", "```{}```"]
    said = F.element_at(F.array(*(F.concat(F.lit(k.split("{}")[0]), F.col("props"), F.lit(k.split("{}")[1])) for k in kinds)), (F.col("event_id") % 7 + 1).cast("int"))
    return R.table(spark, d, "events").select("event_id", cleanup.json_object(said).alias("object"))


@query("SELECT event_id, CASE WHEN event_id % 5 < 2 OR coalesce(value > 50, FALSE) THEN 'enabled' ELSE 'disabled' END AS thinking, CASE WHEN event_id % 5 < 2 THEN CASE WHEN coalesce(value > 50, FALSE) THEN 'high' ELSE 'low' END END AS effort FROM events")
def r5_reasoning(spark, d):
    models = F.array(*map(F.lit, (" GLM-5.3 ", "glm-5.3-air", "glm-4.5", "glm-5", "other")))
    said = X.reasoning(F.element_at(models, (F.col("event_id") % 5 + 1).cast("int")), F.col("value") > 50)
    return R.table(spark, d, "events").select("event_id", said["thinking"].alias("thinking"), said["effort"].alias("effort"))


@query("SELECT doc_id, 'Title: ' || source || CASE WHEN lang <> 'en' THEN '. Category: ' || lang ELSE '' END || CASE WHEN n_chars > 500 THEN '. Vocabulary: ' || lang || ', ' || source ELSE '' END || '.' AS prompt FROM documents")
def r13_asr_prompt(spark, d):
    words = F.when(F.col("n_chars") > 500, F.array("lang", "source")).otherwise(F.array().cast("array<string>"))
    return R.table(spark, d, "documents").select("doc_id", alignment.asr_prompt(F.col("source"), F.when(F.col("lang") == "en", "未分类").otherwise(F.col("lang")), words).alias("prompt"))


@query("WITH p AS (SELECT conv_id, turn, text, greatest(strpos(text, ' la ') - 1, 0) AS k FROM conversations) SELECT conv_id, turn, trim(regexp_extract(left(text, k::BIGINT), '([^，,。！？!?；;：:\\n\\r]*)$', 1) || regexp_extract(substr(text, k + 1), '^([^，,。！？!?；;：:\\n\\r]*)', 1)) AS snippet FROM p")
def g3_snippet(spark, d):
    x = _turns(spark, d).withColumn("k", F.greatest(F.instr("text", F.lit(" la ")) - 1, F.lit(0)))  # or around the beginning
    return x.select("conv_id", "turn", X.snippet(F.col("text"), F.col("k")).alias("snippet"))


@query(f"WITH {R.RAW} SELECT video_id, id, left(sha256('[' || to_json(partition) || ',' || to_json(video_id) || ',' || id || ',' || to_json('la') || ',' || to_json('LA') || ',' || to_json(raw_text) || ']'), 24) AS hit_id FROM raw")
def g4_hit_id(spark, d):
    j = lambda c: X.json_text(F.col(c))
    return R.raw(spark, d).select("video_id", "id", X.hit_id(j("partition"), j("video_id"), F.col("id").cast("string"), F.lit('"la"'), F.lit('"LA"'), j("raw_text")).alias("hit_id"))


_STAGE = "CASE event_type WHEN 'view' THEN 'asr' WHEN 'click' THEN 'cleanup' WHEN 'purchase' THEN 'segments' ELSE 'other' END"


def progress_lines(spark, d):
    """Progress lines derived from events: type as stage, value of 100 as progress."""
    stage = F.when(F.col("event_type") == "view", "asr").when(F.col("event_type") == "click", "cleanup").when(F.col("event_type") == "purchase", "segments").otherwise("other")
    line = F.when(F.col("event_type") == "error", F.concat(F.lit("Traceback "), F.col("props"))).otherwise(jobs.emitted(stage, F.col("value"), F.lit(100), F.concat(F.lit(" k "), F.col("props"), F.lit("\n"))))
    return R.table(spark, d, "events").select("event_id", "user_id", stage.alias("expected_stage"), line.alias("line"))


@query(f"SELECT event_id, {_STAGE} AS stage, greatest(0.0, least(value, 100.0)) / 100.0 AS fraction, 'k ' || props AS detail FROM events WHERE event_type <> 'error'")
def st1_progress_round_trip(spark, d):
    return progress_lines(spark, d).select("event_id", jobs.parsed(F.col("line")).alias("e")).where("e IS NOT NULL").select("event_id", "e.stage", "e.fraction", "e.detail")


_BAND = "CASE event_type WHEN 'view' THEN 5 + round_even(65.0 * f, 0) WHEN 'click' THEN 72 + round_even(13.0 * f, 0) WHEN 'purchase' THEN 87 + round_even(13.0 * f, 0) END::BIGINT"


@query(f"WITH e AS (SELECT *, greatest(0.0, least(value, 100.0)) / 100.0 AS f FROM events WHERE event_type IN ('view', 'click', 'purchase')) SELECT event_id, {_STAGE} AS stage, {_BAND} AS percent FROM e")
def st3_stage_bands(spark, d):
    return jobs.accepted(progress_lines(spark, d)).where("percent IS NOT NULL").select("event_id", "stage", "percent")


@query(f"WITH e AS (SELECT *, greatest(0.0, least(value, 100.0)) / 100.0 AS f FROM events WHERE event_type IN ('view', 'click', 'purchase')) SELECT event_id, user_id, max({_BAND}) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS progress FROM e")
def w8_progress_running_max(spark, d):
    x = jobs.accepted(progress_lines(spark, d)).where("percent IS NOT NULL")
    return jobs.running_max(x, ["user_id"], ["event_id"], "percent").select("event_id", "user_id", "progress")
