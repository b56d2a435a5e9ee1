"""Windows, batching, ranges, joins and aggregates over recordings (W, P, J, A, S, U, R7, R10, T6, T7)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import alignment, batching, catalog, cleanup, glossary, jobs, segments, validation
from lectern.plans import relations as R
from lectern.plans.registry import query

KEY = R.KEY


@query(f"WITH {R.SPOKEN} SELECT video_id, sentence_id, text FROM spoken")
def p1_nonblank(spark, d):
    return segments.nonblank(R.cleaned(spark, d)).select("video_id", "sentence_id", "text")


@query(f"WITH {R.SPOKEN}, n AS (SELECT *, {R.sql_effective('text')} AS n FROM spoken), o AS (SELECT video_id, sentence_id, sum(n) OVER (PARTITION BY video_id ORDER BY sentence_id ROWS UNBOUNDED PRECEDING)::BIGINT AS end_char, n FROM n) SELECT video_id, sentence_id, end_char - n AS start_char, end_char FROM o")
def w1_char_offsets(spark, d):
    return segments.char_offsets(segments.nonblank(R.cleaned(spark, d))).select("video_id", "sentence_id", "start_char", "end_char")


def _shifted(spark, d):
    """Raw sentences with faults: some starts 50 ms early, some ids off by one, some intervals empty, some texts gone."""
    r = R.raw(spark, d)
    n = F.length("raw_text")
    return r.select(*KEY, F.col("id").alias("pos"), F.when(n % 11 == 3, F.col("id") + 1).otherwise(F.col("id")).alias("id"), F.when((n % 7 == 2) & (F.col("id") > 1), F.col("start_ms") - 50).otherwise(F.col("start_ms")).alias("start_ms"), F.when(n % 13 == 5, F.col("start_ms")).otherwise(F.col("end_ms")).alias("end_ms"), F.when(n % 17 != 4, F.col("raw_text")).alias("raw_text"))


_SHIFTED = R.RAW + """,
shifted AS MATERIALIZED (SELECT partition, video_id, id AS pos, CASE WHEN length(raw_text) % 11 = 3 THEN id + 1 ELSE id END AS id, CASE WHEN length(raw_text) % 7 = 2 AND id > 1 THEN start_ms - 50 ELSE start_ms END AS start_ms, CASE WHEN length(raw_text) % 13 = 5 THEN start_ms ELSE end_ms END AS end_ms, CASE WHEN length(raw_text) % 17 <> 4 THEN raw_text END AS raw_text FROM raw)"""


@query(f"WITH {_SHIFTED}, b AS (SELECT *, lag(id) OVER w AS b_id, lag(start_ms) OVER w AS b_start FROM shifted WINDOW w AS (PARTITION BY video_id ORDER BY pos)) SELECT * FROM (SELECT partition, video_id, id AS sentence_id, CASE WHEN id <= b_id THEN 'ids do not rise' WHEN start_ms < 0 OR end_ms <= start_ms OR start_ms < b_start THEN 'times out of order' END AS fault FROM b) WHERE fault IS NOT NULL")
def w2_overlap_violations(spark, d):
    return segments.sentence_faults(_shifted(spark, d).withColumnRenamed("id", "sentence_id"))


@query(f"""WITH {_SHIFTED}, b AS (SELECT *, coalesce(lag(end_ms) OVER (PARTITION BY video_id ORDER BY pos), -1) AS b_end FROM shifted),
h AS (SELECT video_id, partition, arg_max(end_ms, pos) AS last_end, CASE WHEN max(pos) % 2 = 0 THEN arg_max(end_ms, pos) - 1001 ELSE arg_max(end_ms, pos) - 1000 END AS duration_ms, CASE WHEN max(pos) = 5 THEN upper(video_id) ELSE video_id END AS id_in_file FROM shifted GROUP BY video_id, partition)
SELECT partition, video_id, 'raw.id' AS rule, pos FROM b WHERE id <> pos UNION ALL SELECT partition, video_id, 'raw.times', pos FROM b WHERE NOT (start_ms >= 0 AND end_ms > start_ms) UNION ALL SELECT partition, video_id, 'raw.overlap', pos FROM b WHERE start_ms < b_end UNION ALL SELECT partition, video_id, 'raw.text', pos FROM b WHERE raw_text IS NULL
UNION ALL SELECT partition, video_id, 'raw.video', 0 FROM h WHERE id_in_file <> video_id UNION ALL SELECT partition, video_id, 'raw.late', 0 FROM h WHERE duration_ms <> 0 AND last_end > duration_ms + 1000""")
def v1_raw_errors(spark, d):
    raw = _shifted(spark, d)
    n, end = F.max("pos"), F.max_by("end_ms", "pos")
    heads = raw.groupBy(*KEY).agg(F.when(n % 2 == 0, end - 1001).otherwise(end - 1000).alias("duration_ms"), F.when(n == 5, F.upper("video_id")).otherwise(F.col("video_id")).alias("id_in_file"))
    return validation.raw_faults(raw, heads)


@query(f"WITH RECURSIVE {R.CHAPTERS} SELECT video_id, segment_no, start_sentence_id, end_sentence_id, start_ms, end_ms FROM chapters")
def w3_segment_ranges(spark, d):
    return R.chapters(spark, d).select("video_id", "segment_no", "start_sentence_id", "end_sentence_id", "start_ms", "end_ms")


@query(f"WITH RECURSIVE {R.CHAPTERS} SELECT partition, video_id, segment_no, md5(content) AS content, length(joined)::BIGINT AS n FROM chapters")
def r10_segments(spark, d):
    return R.chapters(spark, d).select(*KEY, "segment_no", F.md5("content").alias("content"), F.length("joined").cast("long").alias("n"))


@query(f"WITH RECURSIVE {R.CHAPTERS} SELECT c.video_id, c.segment_no, a.start_ms, b.end_ms FROM chapters c JOIN cleaned a ON a.video_id = c.video_id AND a.sentence_id = c.start_sentence_id JOIN cleaned b ON b.video_id = c.video_id AND b.sentence_id = c.end_sentence_id")
def j3_segment_times(spark, d):
    g, c = R.chapters(spark, d).select("video_id", "segment_no", "start_sentence_id", "end_sentence_id").alias("g"), R.cleaned(spark, d)
    a, b = c.alias("a"), c.alias("b")
    x = g.join(a, F.expr("g.video_id = a.video_id AND g.start_sentence_id = a.sentence_id")).join(b, F.expr("g.video_id = b.video_id AND g.end_sentence_id = b.sentence_id"))
    return x.select("g.video_id", "g.segment_no", "a.start_ms", "b.end_ms")


_BATCHES = R.RAW + ",\n" + R.sql_greedy("b", "raw", "id", "length(raw_text)", *R.BATCH)


def _batched(spark, d):
    return batching.greedy_batches(R.raw(spark, d).withColumn("size", F.length("raw_text").cast("long")), KEY, "id", "size", *R.BATCH)


@query(f"WITH RECURSIVE {_BATCHES} SELECT video_id, id, batch FROM b")
def w6_sentence_batches(spark, d):
    return _batched(spark, d).select("video_id", "id", "batch")


@query(f"""WITH RECURSIVE {_BATCHES}, e AS (SELECT video_id, batch, min(id) AS first_id, max(id) AS last_id FROM b GROUP BY ALL)
SELECT e.*, coalesce((SELECT string_agg(raw_text, '|' ORDER BY id) FROM raw r WHERE r.video_id = e.video_id AND r.id BETWEEN first_id - 2 AND first_id - 1), '') AS before, coalesce((SELECT string_agg(raw_text, '|' ORDER BY id) FROM raw r WHERE r.video_id = e.video_id AND r.id BETWEEN last_id + 1 AND last_id + 2), '') AS after FROM e""")
def w4_context_frames(spark, d):
    return cleanup.context(_batched(spark, d)).select("video_id", "batch", "first_id", "last_id", F.array_join("before", "|").alias("before"), F.array_join("after", "|").alias("after"))


@query(f"WITH RECURSIVE {_BATCHES} SELECT r.video_id, b.batch, count(*) AS targets, sum(length(raw_text))::BIGINT AS chars, min(id) AS first_id FROM raw r JOIN b USING (video_id, id) GROUP BY ALL")
def r6_cleanup_prompts(spark, d):
    p = cleanup.prompts(_batched(spark, d), R.raw(spark, d).select(*KEY).distinct().withColumn("title", F.left("video_id", F.lit(12))), ["la", "de"])
    t = F.from_json("prompt", "target_sentences array<struct<sentence_id:long,text:string>>")["target_sentences"]
    return p.select("video_id", "batch", F.size(t).cast("long").alias("targets"), F.aggregate(t, F.lit(0).cast("long"), lambda a, r: a + F.length(r["text"])).alias("chars"), F.array_min(F.transform(t, lambda r: r["sentence_id"])).alias("first_id"))


_SIGNALS = R.RAW + """,
sig AS MATERIALIZED (SELECT partition, video_id, (id - 1) // 4 AS batch, id AS idx, id, CASE WHEN length(raw_text) % 5 < 4 THEN 1 ELSE -1 END AS offset_ FROM raw WHERE length(raw_text) % 9 <> 0)"""


@query(f"WITH {_SIGNALS}, i AS (SELECT *, idx - row_number() OVER (PARTITION BY video_id, batch, offset_ ORDER BY idx) AS island FROM sig), r AS (SELECT *, count(*) OVER (PARTITION BY video_id, batch, offset_, island) AS run FROM i) SELECT video_id, id, offset_::BIGINT AS offset_, run FROM r WHERE run >= 3")
def w5_drift_runs(spark, d):
    n = F.length("raw_text")
    s = R.raw(spark, d).select(*KEY, F.floor((F.col("id") - 1) / 4).alias("batch"), F.col("id").alias("idx"), "id", F.when(n % 9 == 0, 0).when(n % 5 < 4, 1).otherwise(-1).cast("long").alias("offset"))
    return cleanup.drift_runs(s).select("video_id", "id", F.col("offset").alias("offset_"), "run")


@query(f"WITH RECURSIVE {R.CHAPTERS},\n{R.sql_greedy('lb', 'chapters', 'segment_no', 'length(joined)', *R.LABELS)} SELECT video_id, segment_no, batch FROM lb")
def w7_label_batches(spark, d):
    return segments.label_batches(R.chapters(spark, d), *R.LABELS).select("video_id", "segment_no", "batch")


@query(f"WITH RECURSIVE {R.CHAPTERS} SELECT video_id, start_sentence_id, row_number() OVER (PARTITION BY video_id ORDER BY start_sentence_id) AS segment_no FROM chapters")
def w10_segment_no(spark, d):
    s = segments.greedy_starts(segments.nonblank(R.cleaned(spark, d)), R.CHAPTER)
    return s.select("video_id", "start_sentence_id", F.row_number().over(W.partitionBy("video_id").orderBy("start_sentence_id")).cast("long").alias("segment_no"))


_WINDOWS = _BATCHES + """,
win AS MATERIALIZED (SELECT video_id, id, batch, (row_number() OVER (PARTITION BY video_id, batch ORDER BY id) - 1) // 5 AS "window" FROM b)"""


@query(f'WITH RECURSIVE {_WINDOWS} SELECT video_id, id, batch, "window" FROM win')
def w11_recovery_windows(spark, d):
    return batching.recovery_windows(_batched(spark, d), [*KEY, "batch"], "id").select("video_id", "id", "batch", "window")


@query("""WITH f AS (SELECT user_id, event_id, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
p AS (SELECT *, failed AND lag(failed) OVER (PARTITION BY user_id ORDER BY event_id) AS two FROM f) SELECT user_id, min(rn) FILTER (two)::BIGINT AS stops_at FROM p GROUP BY user_id""")
def w11_circuit_breaker(spark, d):
    e = R.table(spark, d, "events").groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", (F.col("event_type") == "error").alias("f")))), lambda s: s["f"]).alias("f"))
    return e.select("user_id", batching.circuit_open(F.col("f")).cast("long").alias("stops_at"))


@query("SELECT event_id AS seq, event_type AS stage FROM events ORDER BY event_id DESC LIMIT 20")
def w12_latest_jobs(spark, d):
    return jobs.latest(R.table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("stage")))


@query(f"WITH {R.DECIDED} SELECT video_id, id, status, md5(effective_text) AS effective FROM decided")
def p5_review_status(spark, d):
    return R.decided(spark, d).select("video_id", "id", "status", F.md5("effective_text").alias("effective"))


@query(f"WITH {R.DECIDED} SELECT video_id, id, status, proposed_text FROM decided WHERE status = 'pending_review' OR proposed_text <> raw_text")
def p4_audit_changes(spark, d):
    return cleanup.changes(R.decided(spark, d)).select("video_id", "id", "status", "proposed_text")


@query("SELECT event_id, CASE event_type WHEN 'view' THEN '' WHEN 'click' THEN 'needs_review, review_reason' ELSE 'needs_review, review_reason, text' END AS missing FROM events")
def p7_required_fields(spark, d):
    keys = F.when(F.col("event_type") == "view", F.array(*(F.lit(x) for x in cleanup.REQUIRED))).when(F.col("event_type") == "click", F.array(F.lit("sentence_id"), F.lit("text"), F.lit("extra"))).otherwise(F.array(F.lit("sentence_id")))
    row = F.map_from_arrays(keys, F.transform(keys, lambda k: F.lit(1)))
    return R.table(spark, d, "events").select("event_id", cleanup.missing_fields(row, cleanup.REQUIRED).alias("missing"))


@query(f"WITH {R.CLEANED} SELECT video_id, sentence_id, text FROM cleaned")
def j4_apply_pending(spark, d):
    return R.cleaned(spark, d).select("video_id", "sentence_id", "text")


@query(f"WITH RECURSIVE {R.CHAPTERS} SELECT s.video_id, s.sentence_id, count(c.segment_no) AS covering FROM spoken s LEFT JOIN chapters c ON c.video_id = s.video_id AND s.sentence_id BETWEEN c.start_sentence_id AND c.end_sentence_id GROUP BY ALL")
def j2_segment_coverage(spark, d):
    return validation.coverage(R.cleaned(spark, d), R.chapters(spark, d)).select("video_id", "sentence_id", "covering")


@query(f"WITH RECURSIVE {R.CHAPTERS} SELECT d.video_id, d.id, c.segment_no FROM decided d JOIN chapters c ON c.video_id = d.video_id AND d.id BETWEEN c.start_sentence_id AND c.end_sentence_id WHERE d.status = 'pending_review'")
def j5_suggestions_in_chapter(spark, d):
    s, g = R.decided(spark, d).where("status = 'pending_review'").alias("s"), R.chapters(spark, d).alias("g")
    return s.join(g, F.expr("s.video_id = g.video_id AND s.id BETWEEN g.start_sentence_id AND g.end_sentence_id")).select("s.video_id", "s.id", "g.segment_no")


@query(f"WITH {R.RAW} SELECT a.video_id, a.id, b.id - a.id AS offset_, b.raw_text AS text FROM raw a JOIN raw b ON a.video_id = b.video_id AND abs(b.id - a.id) BETWEEN 1 AND 2")
def j8_neighbor_pairs(spark, d):
    return cleanup.neighbours(R.raw(spark, d)).select("video_id", "id", F.col("offset").cast("long").alias("offset_"), "text")


@query(f"WITH {R.DECIDED} SELECT video_id, status, count(*) AS n FROM decided GROUP BY ALL")
def a_stat(spark, d):
    return cleanup.status_counts(R.decided(spark, d)).select("video_id", "status", "n")


@query(f"WITH {R.DECIDED}, n AS (SELECT video_id, count(*) FILTER (status = 'unchanged') AS u, count(*) FILTER (status = 'auto_accepted') AS a, count(*) FILTER (status = 'pending_review') AS p FROM decided GROUP BY ALL) SELECT video_id, concat_ws(';', CASE WHEN a > 0 THEN 'auto_accepted=' || a END, CASE WHEN p > 0 THEN 'pending=' || p END, CASE WHEN u > 0 THEN 'unchanged=' || u END) AS counts, CASE WHEN p > 0 THEN 'pending_review' ELSE 'completed' END AS status FROM n")
def r11_audit(spark, d):
    text = F.array_join(F.array_sort(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ";")
    return cleanup.audit(R.decided(spark, d)).select("video_id", text.alias("counts"), "status")


@query("SELECT user_id::VARCHAR AS video_id, sum(event_id)::BIGINT AS prompt_tokens, sum(length(event_type))::BIGINT AS completion_tokens, sum(event_id + length(event_type))::BIGINT AS total_tokens, count(*) AS requests FROM events GROUP BY ALL")
def a_usage(spark, d):
    n = F.length("event_type").cast("long")
    return jobs.usage(R.table(spark, d, "events").select(F.col("user_id").cast("string").alias("video_id"), F.col("event_id").alias("prompt_tokens"), n.alias("completion_tokens"), (F.col("event_id") + n).alias("total_tokens")))


@query("""WITH c AS (SELECT source AS video_id, CASE WHEN n_chars % 10 = 0 THEN ' ' ELSE lang END AS language, doc_id AS pos FROM documents), n AS (SELECT video_id, language, count(*) AS n, min(pos) AS first FROM c WHERE language <> ' ' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY n DESC, first) AS rn FROM n) SELECT v.video_id, coalesce(r.language, 'Chinese') AS language FROM (SELECT DISTINCT video_id FROM c) v LEFT JOIN r ON r.video_id = v.video_id AND rn = 1""")
def a_lang_mode(spark, d):
    x = R.table(spark, d, "documents").select(F.col("source").alias("video_id"), F.when(F.col("n_chars") % 10 == 0, " ").otherwise(F.col("lang")).alias("language"), F.col("doc_id").alias("pos"))
    return alignment.most_language(x)


@query(f"WITH {R.CLEANED} SELECT video_id, string_agg(text, chr(10) ORDER BY sentence_id) FILTER (text <> '') AS full_text FROM cleaned GROUP BY ALL")
def a_full_text(spark, d):
    return cleanup.full_text(R.cleaned(spark, d)).select("video_id", "full_text")


@query(f"WITH {R.SPOKEN} SELECT video_id, count(*) AS sentence_count, sum({R.sql_effective('text')})::BIGINT AS total_chars FROM spoken GROUP BY ALL")
def a_total_chars(spark, d):
    return segments.payload(segments.nonblank(R.cleaned(spark, d))).select("video_id", "sentence_count", "total_chars")


@query(f"""WITH {R.SPOKEN}, n AS (SELECT *, {R.sql_effective('text')} AS n FROM spoken), o AS (SELECT video_id, sentence_id, text, n, sum(n) OVER (PARTITION BY video_id ORDER BY sentence_id ROWS UNBOUNDED PRECEDING)::BIGINT AS e FROM n)
SELECT video_id, '[' || string_agg('[' || sentence_id || ',' || (e - n) || ',' || e || ',' || to_json(text) || ']', ',' ORDER BY sentence_id) || ']' AS sentences FROM o GROUP BY ALL""")
def r7_payload(spark, d):
    return segments.payload(segments.nonblank(R.cleaned(spark, d))).select("video_id", "sentences")


@query(f"WITH RECURSIVE {R.LABELLED} SELECT video_id, segment_no, title, summary, array_to_string(keywords, '|') AS keywords FROM labelled")
def a_keywords(spark, d):
    return R.labelled(spark, d).select("video_id", "segment_no", "title", "summary", F.array_join("keywords", "|").alias("keywords"))


@query("WITH i AS (SELECT user_id AS job_id, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n, least(100, value)::BIGINT AS progress, event_id FROM (SELECT *, floor(value) AS v FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT job_id, event_id, round_even((pos * 100 + progress) / n::DOUBLE, 0)::BIGINT AS job_progress FROM i")
def a_progress(spark, d):
    p = W.partitionBy("user_id")
    x = R.table(spark, d, "events").select(F.col("user_id").alias("job_id"), "event_id", (F.row_number().over(p.orderBy("event_id")) - 1).alias("pos"), F.count("*").over(p).alias("n_items"), F.rint(F.least(F.lit(100.0), "value")).cast("long").alias("progress"))
    return jobs.job_progress(x).select("job_id", "event_id", "job_progress")


_HEAD = "'# ' || left(video_id, 12) || chr(10) || chr(10) || '> 视频 ID：`' || video_id || '`  ' || chr(10) || '> 片段数：' || count(*) || chr(10) || chr(10)"
_WORDS = "CASE WHEN len(keywords) > 0 THEN chr(10) || '> 关键词：' || array_to_string(keywords, '、') ELSE '' END"


@query(f"""WITH RECURSIVE {R.LABELLED}, b AS (SELECT *, '## ' || segment_no || '. ' || coalesce(nullif(trim(title), ''), '片段 ' || segment_no) || chr(10) || chr(10) || '> 时间：' || {R.sql_timecode('start_ms')} || '–' || {R.sql_timecode('end_ms')} || '  ' || chr(10) || '> 句子：' || start_sentence_id || '–' || end_sentence_id || {_WORDS} || chr(10) || chr(10) || '### 摘要' || chr(10) || chr(10) || coalesce(nullif(summary, ''), '（无）') || chr(10) || chr(10) || '### 正文' || chr(10) || chr(10) || coalesce(nullif(content, ''), '（无）') || chr(10) AS body FROM labelled)
SELECT video_id, {_HEAD} || string_agg(body, chr(10) ORDER BY segment_no) AS markdown FROM b GROUP BY video_id""")
def t6_markdown(spark, d):
    g = R.labelled(spark, d)
    titles = R.raw(spark, d).select(*KEY).distinct().withColumn("title", F.left("video_id", F.lit(12)))
    return segments.document_markdown(g, titles).select("video_id", "markdown")


@query(f"WITH RECURSIVE {R.LABELLED} SELECT video_id, segment_no, '## ' || coalesce(nullif(trim(title), ''), '未命名章节') || chr(10) || chr(10) || '> 时间：' || {R.sql_timecode('start_ms')} || '–' || {R.sql_timecode('end_ms')} || chr(10) || '> 关键词：' || coalesce(nullif(array_to_string(keywords, '、'), ''), '无') || chr(10) || chr(10) || '### 章节摘要' || chr(10) || chr(10) || {R.sql_paragraph('summary')} || chr(10) || chr(10) || '### 章节正文' || chr(10) || chr(10) || {R.sql_paragraph('content')} || chr(10) AS markdown FROM labelled")
def t7_chapter_markdown(spark, d):
    m = segments.chapter_markdown(*(F.col(c) for c in ("title", "summary", "keywords", "start_ms", "end_ms", "content")))
    return R.labelled(spark, d).select("video_id", "segment_no", m.alias("markdown"))


@query("""WITH e AS (SELECT p_partkey AS ord, p_type AS term, unnest(string_split(p_name || ' ' || p_type, ' ')) AS alias, generate_subscripts(string_split(p_name || ' ' || p_type, ' '), 1) AS place FROM part),
p AS (SELECT alias, term, min(row(ord, place)) AS first FROM e WHERE alias <> term AND regexp_full_match(alias, '[㐀-鿿A-Za-z0-9·_-]+') GROUP BY ALL)
SELECT row_number() OVER (ORDER BY -length(alias), first, alias, term) - 1 AS rank, alias, term FROM p""")
def s2_alias_order(spark, d):
    """An entry for each part: its type, and the words of its name."""
    words = F.split(F.concat_ws(" ", "p_name", "p_type"), " ")
    pairs = glossary.pairs_of(R.table(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.col("p_type").alias("term"), words.alias("aliases")))
    order = W.partitionBy(F.lit(0)).orderBy("n", "ord", "at", "alias", "term")  # distinct pairs of types and words, which are few
    return pairs.select((F.row_number().over(order) - 1).cast("long").alias("rank"), "alias", "term")


@query("SELECT user_id::VARCHAR AS video_id, event_id AS pos, event_type AS term FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) WHERE rn <= 20")
def s7_top20(spark, d):
    return glossary.first_candidates(R.table(spark, d, "events").select(F.col("user_id").cast("string").alias("video_id"), F.col("event_id").alias("pos"), F.col("event_type").alias("term")))


@query("SELECT user_id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ',') AS words FROM (SELECT user_id, ['la', 'view'] || list(event_type ORDER BY event_id) AS w FROM events GROUP BY user_id)")
def u2_hotwords(spark, d):
    own = F.transform(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))), lambda s: F.concat(F.lit(" "), s["event_type"]))
    x = R.table(spark, d, "events").groupBy("user_id").agg(own.alias("own"))
    return x.select("user_id", F.array_join(glossary.hotwords(F.array(F.lit("la"), F.lit(" ")), F.array(F.lit("view")), F.col("own")), ",").alias("words"))


@query("WITH e AS (SELECT conv_id, max(turn) AS m FROM conversations GROUP BY conv_id), w AS (SELECT conv_id, unnest(range(0, m + 3)) AS position FROM e) SELECT w.conv_id, w.position FROM w ANTI JOIN conversations c ON c.conv_id = w.conv_id AND c.turn = w.position")
def u4_missing_positions(spark, d):
    x = R.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_except(F.sequence(F.lit(0).cast("long"), F.max("turn") + 2), F.collect_set("turn")).alias("m"))
    return x.select("conv_id", F.explode("m").alias("position"))
