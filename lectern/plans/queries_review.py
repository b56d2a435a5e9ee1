"""Catalog, validation, glossary and edit queries (C3, V, G, E, J1-J12, A-DASH, A-DEC), and the flagship."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import catalog, cleanup, edits, glossary, jobs, segments, validation
from lectern.plans import relations as R
from lectern.plans.registry import query

KEY = R.KEY
NOW = "2026-01-01T00:00:00+00:00"


# --- flagship: chapters with the number of their faults


@query(f"WITH RECURSIVE {R.CHAPTERS} SELECT video_id, segment_no, start_sentence_id, end_sentence_id, start_ms, end_ms, md5(content) AS content, 0::BIGINT AS faults FROM chapters")
def flagship_chapters(spark, d):
    c = R.cleaned(spark, d)
    g = R.chapters(spark, d).drop("joined").withColumn("manual", F.lit(False))
    bad = validation.segment_faults(c, g).groupBy(*KEY).agg(F.count("*").alias("faults"))
    return g.join(bad, KEY, "left").select("video_id", "segment_no", "start_sentence_id", "end_sentence_id", "start_ms", "end_ms", F.md5("content").alias("content"), F.coalesce("faults", F.lit(0)).cast("long").alias("faults"))


# --- catalog


def _stages(spark, d):
    """Presence of stages by what a conversation holds: cleaned with a digit-free first turn, chaptered from three turns on, a business note with a system turn."""
    c = R.table(spark, d, "conversations")
    i = F.sha2(F.col("conv_id").cast("string"), 256).alias("id")
    n = c.groupBy("conv_id").agg(F.count("*").alias("n"), F.max("turn").alias("m"), F.count_if(F.col("role") == "system").alias("s"), F.sum(10 * F.length("text") + 1).alias("ms"))
    lab = R.table(spark, d, "labels").groupBy(F.col("doc_id").alias("conv_id")).agg(F.max("quality").alias("q"))
    n = n.join(lab, "conv_id", "left")
    name = lambda p: F.concat(F.lit(p), F.col("conv_id").cast("string"))
    raw = n.select(i, F.when(F.col("n") > 4, name("talk ")).alias("title"), F.col("ms").alias("duration_ms"), F.col("n").alias("sentence_count"), F.concat(F.lit("2026-0"), (F.col("n") % 9 + 1).cast("string")).alias("processed_at"))
    cleaned = n.where("n > 2").select(i, F.when(F.col("n") > 6, name("clean ")).otherwise("").alias("title"))
    seg = n.where("n > 3").select(i, F.lit(None).cast("string").alias("title"), F.when(F.col("q") == 1, "confirmed").alias("review_status"), F.floor(F.col("n") / 3).alias("segment_count"))
    bus = n.where("s > 0").select(i, name("note ").alias("title"), F.col("s").alias("annotation_count"))
    up = R.table(spark, d, "pages").select(F.sha2(F.col("page_id").cast("string"), 256).alias("id"), F.concat(X.base_name(F.col("url")), F.lit(".mp4")).alias("filename"), F.concat(F.lit("2026-0"), (F.length("url") % 9 + 1).cast("string")).alias("uploaded_at"))
    hist = n.where("n > 2 AND m > 3").select(i)
    return {"raw": raw, "cleaned": cleaned, "segments": seg, "business": bus, "uploads": up, "history": hist, "videos": raw.select("id")}


_CATALOG = """n AS MATERIALIZED (SELECT sha256(conv_id::VARCHAR) AS id, conv_id, count(*) AS n, max(turn) AS m, count(*) FILTER (role = 'system') AS s, sum(10 * length(text) + 1)::BIGINT AS ms, any_value(q) AS q FROM conversations LEFT JOIN (SELECT doc_id AS conv_id, max(quality) AS q FROM labels GROUP BY doc_id) USING (conv_id) GROUP BY conv_id),
up AS (SELECT sha256(page_id::VARCHAR) AS id, regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1) AS name, '2026-0' || (length(url) % 9 + 1) AS uploaded_at FROM pages),
rec AS MATERIALIZED (SELECT coalesce(n.id, up.id) AS id, coalesce(CASE WHEN n > 6 THEN 'clean ' || conv_id END, CASE WHEN s > 0 THEN 'note ' || conv_id END, CASE WHEN n > 4 THEN 'talk ' || conv_id END, nullif(name, ''), left(coalesce(n.id, up.id), 12)) AS title, up.id IS NOT NULL AS uploaded, true AS has_video, n.id IS NOT NULL AS has_raw, coalesce(n > 2, false) AS has_cleaned, coalesce(n > 3, false) AS has_segments, coalesce(s > 0, false) AS has_business, coalesce(n > 2 AND m > 3, false) AS has_history,
CASE WHEN n > 3 THEN CASE WHEN q = 1 THEN 'confirmed' ELSE 'pending_review' END ELSE 'not_ready' END AS review_status, coalesce(ms, 0) AS duration_ms, coalesce(n, 0) AS sentence_count, CASE WHEN n > 3 THEN n // 3 ELSE 0 END AS segment_count, CASE WHEN s > 0 THEN s ELSE 0 END AS business_annotation_count, coalesce('2026-0' || (n % 9 + 1), '') AS processed_at, coalesce(uploaded_at, '') AS uploaded_at FROM n FULL JOIN up USING (id)),
pri AS MATERIALIZED (SELECT *, (CASE WHEN uploaded AND NOT has_raw THEN 0 WHEN NOT (has_raw AND has_cleaned AND has_segments) THEN 1 WHEN review_status <> 'confirmed' THEN 2 ELSE 3 END)::BIGINT AS priority FROM rec)"""


def _records(spark, d):
    return catalog.records(**_stages(spark, d))


@query(f"WITH {_CATALOG} SELECT * FROM rec")
def c3_catalog(spark, d):
    return _records(spark, d)


@query(f"WITH {_CATALOG} SELECT id, has_raw, has_cleaned, has_segments, has_business, has_history, review_status FROM rec")
def p8_catalog_flags(spark, d):
    return _records(spark, d).select("id", "has_raw", "has_cleaned", "has_segments", "has_business", "has_history", "review_status")


@query(f"WITH {_CATALOG} SELECT count(*) AS videos, count(*) FILTER (uploaded AND NOT has_raw) AS uploaded, count(*) FILTER (has_raw) AS raw, count(*) FILTER (has_cleaned) AS cleaned, count(*) FILTER (has_segments) AS segments, count(*) FILTER (has_business) AS business, count(*) FILTER (has_segments AND review_status <> 'confirmed') AS pending_review, count(*) FILTER (review_status = 'confirmed') AS completed FROM rec")
def a_dash(spark, d):
    return catalog.counts(_records(spark, d))


@query(f"WITH {_CATALOG} SELECT id, priority, title FROM pri ORDER BY priority, greatest(uploaded_at, processed_at) DESC, title, id")
def s1_dashboard_order(spark, d):
    return catalog.ordered(_records(spark, d)).select("id", catalog.priority().alias("priority"), "title")


@query(f"WITH {_CATALOG} SELECT id, title FROM rec WHERE contains(lower(title), 'clean 1')")
def p12_title_search(spark, d):
    return catalog.search(_records(spark, d), "  Clean 1 ").select("id", "title")


@query(f"WITH {_CATALOG} SELECT id FROM rec")
def j6_catalog_ids(spark, d):
    t = _stages(spark, d)
    return catalog.all_ids(*(t[k] for k in ("raw", "cleaned", "segments", "business", "uploads", "history")))


@query(f"WITH {_CATALOG} SELECT sha256(page_id::VARCHAR) AS id FROM pages WHERE sha256(page_id::VARCHAR) NOT IN (SELECT id FROM n)")
def j10_todo_anti(spark, d):
    t = _stages(spark, d)
    return catalog.todo(t["uploads"], t["raw"]).select("id")


@query(f"WITH {_CATALOG} SELECT id, 'asr' AS stage FROM rec WHERE has_cleaned UNION ALL SELECT id, 'cleanup' FROM rec WHERE has_segments OR has_history UNION ALL SELECT id, 'segments' FROM rec WHERE review_status = 'confirmed' OR sentence_count > 7")
def p11_overwrite_guard(spark, d):
    x = _records(spark, d).withColumns({"revision": F.when(F.col("sentence_count") > 7, 1).otherwise(0), "manual": F.lit(False)})
    return validation.all_faults(*(catalog.blocked(x, s).withColumn("stage", F.lit(s)) for s in catalog.STAGES))


@query(f"WITH {_CATALOG} SELECT n.id FROM n WHERE n.id IN (SELECT id FROM up)")
def j11_guard_semi(spark, d):
    t = _stages(spark, d)
    return t["raw"].join(t["uploads"].select("id"), "id", "left_semi").select("id")


@query(f"WITH {_CATALOG} SELECT sha256(page_id::VARCHAR) AS id, CASE WHEN page_id % 2 = 0 THEN 'cleanup' ELSE 'segments' END AS stage FROM pages LEFT JOIN n ON n.id = sha256(page_id::VARCHAR) WHERE coalesce(n.n, 4) = 4 OR (page_id % 2 = 1 AND n.n <= 2)")
def p10_missing_inputs(spark, d):
    t = _stages(spark, d)
    ask = R.table(spark, d, "pages").select(F.sha2(F.col("page_id").cast("string"), 256).alias("id"), F.when(F.col("page_id") % 2 == 0, "cleanup").otherwise("segments").alias("stage"))
    return jobs.missing_inputs(ask, t["raw"].where("sentence_count <> 4"), t["cleaned"])  # four sentences: cleaned, but the raw ones are gone


@query(f"WITH {R.DECIDED} SELECT video_id, id AS sentence_id, proposed_text, 'current' AS source FROM decided WHERE status = 'pending_review'")
def p6_suggestions(spark, d):
    return catalog.suggestions(R.decided(spark, d).withColumnRenamed("id", "sentence_id")).select("video_id", "sentence_id", "proposed_text", "source")


@query("WITH f AS (SELECT 'v/t__' || left(sha256(conv_id::VARCHAR), 16) || '.mp4' AS path, conv_id FROM conversations UNION SELECT 'v/s__' || left(sha256(conv_id::VARCHAR), 16) || '.mov', conv_id FROM conversations WHERE turn = 4) SELECT sha256(conv_id::VARCHAR) AS id, min(path) AS path, count(DISTINCT path) AS n FROM f GROUP BY conv_id")
def src6_video_paths(spark, d):
    c = R.table(spark, d, "conversations")
    i = F.sha2(F.col("conv_id").cast("string"), 256)
    f = c.select(F.concat(F.lit("v/t__"), F.left(i, F.lit(16)), F.lit(".mp4")).alias("path")).union(c.where("turn = 4").select(F.concat(F.lit("v/s__"), F.left(i, F.lit(16)), F.lit(".mov")))).distinct()
    return catalog.video_paths(f, c.select(i.alias("id")).distinct())


# --- validation


def _damaged(spark, d):
    """Cleaned sentences with faults: first rows gone in some videos, times off or texts gone in others."""
    c = R.cleaned(spark, d)
    h = F.ascii(F.right("video_id", F.lit(1))) % 4
    return c.where(~((h == 0) & (F.col("sentence_id") == 1))).withColumns({"end_ms": F.when((h == 1) & (F.col("sentence_id") == 2), F.col("end_ms") + 1).otherwise(F.col("end_ms")), "text": F.when(~((h == 2) & (F.col("sentence_id") == 3)), F.col("text"))})


_DAMAGED = R.CLEANED + """,
damaged AS MATERIALIZED (SELECT partition, video_id, sentence_id, start_ms, CASE WHEN ascii(right(video_id, 1)) % 4 = 1 AND sentence_id = 2 THEN end_ms + 1 ELSE end_ms END AS end_ms, CASE WHEN NOT (ascii(right(video_id, 1)) % 4 = 2 AND sentence_id = 3) THEN text END AS text FROM cleaned WHERE NOT (ascii(right(video_id, 1)) % 4 = 0 AND sentence_id = 1)),
full_ AS MATERIALIZED (SELECT partition, video_id, string_agg(text, chr(10) ORDER BY sentence_id) FILTER (text <> '') AS full_text FROM cleaned GROUP BY ALL),
same AS (SELECT video_id FROM raw GROUP BY video_id HAVING count(*) = (SELECT count(*) FROM damaged x WHERE x.video_id = raw.video_id)),
v2 AS MATERIALIZED (SELECT partition, video_id, 'cleaned.count' AS rule, 0 AS pos FROM (SELECT DISTINCT partition, video_id FROM raw) WHERE video_id NOT IN (SELECT video_id FROM same)
UNION ALL SELECT r.partition, r.video_id, 'cleaned.anchor', r.id FROM raw r JOIN damaged x ON x.video_id = r.video_id AND x.sentence_id = r.id WHERE r.end_ms <> x.end_ms AND r.video_id IN (SELECT video_id FROM same)
UNION ALL SELECT partition, video_id, 'cleaned.text', sentence_id FROM damaged WHERE text IS NULL AND video_id IN (SELECT video_id FROM same)
UNION ALL SELECT f.partition, f.video_id, 'cleaned.full_text', 0 FROM full_ f JOIN (SELECT video_id, coalesce(string_agg(text, chr(10) ORDER BY sentence_id) FILTER (text <> ''), '') AS t FROM damaged GROUP BY video_id) x USING (video_id) WHERE f.full_text <> x.t AND video_id IN (SELECT video_id FROM same)
UNION ALL SELECT partition, video_id, 'cleaned.source', 0 FROM full_ WHERE ascii(video_id) % 8 IN (1, 2))"""


def _v2(spark, d):
    h = F.ascii("video_id") % 8
    named = F.when(h == 1, "other").when(h != 2, F.col("video_id"))
    return validation.cleaned_faults(R.raw(spark, d), _damaged(spark, d), cleanup.full_text(R.cleaned(spark, d)).withColumn("source_id", named))


@query(f"WITH {_DAMAGED} SELECT partition, video_id, rule, pos FROM v2")
def v2_cleaned_errors(spark, d):
    return _v2(spark, d)


@query(f"WITH {_DAMAGED} SELECT video_id, pos AS id FROM v2 WHERE rule = 'cleaned.anchor'")
def j1_raw_clean_diff(spark, d):
    return _v2(spark, d).where("rule = 'cleaned.anchor'").select("video_id", F.col("pos").alias("id"))


@query(f"WITH {_DAMAGED}, n AS (SELECT count(DISTINCT video_id) AS total, (SELECT count(DISTINCT video_id) FROM v2) AS failed FROM raw) SELECT total - failed AS passed, failed, total, (CASE WHEN failed > 0 THEN 1 ELSE 0 END)::BIGINT AS exit_code FROM n")
def a_validation_totals(spark, d):
    return validation.totals(R.raw(spark, d).select(*KEY).distinct(), _v2(spark, d))


def _bent(spark, d):
    """Chapters with faults: some second ones a sentence late, some first contents changed, some times off."""
    g = R.chapters(spark, d).drop("joined")
    h = F.ascii(F.right("video_id", F.lit(1))) % 3
    second = (h == 0) & (F.col("segment_no") == 2)
    return g.withColumns({"content": F.when((h == 1) & (F.col("segment_no") == 1), F.concat("content", F.lit("x"))).otherwise(F.col("content")), "end_ms": F.when((h == 2) & (F.col("segment_no") == 1), F.col("end_ms") + 1).otherwise(F.col("end_ms")), "start_sentence_id": F.when(second, F.col("start_sentence_id") + 1).otherwise(F.col("start_sentence_id")), "manual": F.lit(False)})


@query(f"""WITH RECURSIVE {R.CHAPTERS}, bent AS MATERIALIZED (SELECT partition, video_id, segment_no, end_sentence_id, start_ms, ascii(right(video_id, 1)) % 3 AS h, CASE WHEN h = 1 AND segment_no = 1 THEN content || 'x' ELSE content END AS content, CASE WHEN h = 2 AND segment_no = 1 THEN end_ms + 1 ELSE end_ms END AS end_ms, CASE WHEN h = 0 AND segment_no = 2 THEN start_sentence_id + 1 ELSE start_sentence_id END AS start_sentence_id FROM chapters),
held AS (SELECT b.partition, b.video_id, b.segment_no, b.content, string_agg(s.text, chr(10) ORDER BY s.sentence_id) AS t FROM bent b JOIN spoken s ON s.video_id = b.video_id AND s.sentence_id BETWEEN b.start_sentence_id AND b.end_sentence_id GROUP BY ALL)
SELECT b.partition, b.video_id, 'segments.anchor' AS rule, segment_no AS pos FROM bent b LEFT JOIN cleaned a ON a.video_id = b.video_id AND a.sentence_id = b.start_sentence_id WHERE a.sentence_id IS NULL OR b.end_sentence_id < b.start_sentence_id
UNION ALL SELECT b.partition, b.video_id, 'segments.times', segment_no FROM bent b JOIN cleaned a ON a.video_id = b.video_id AND a.sentence_id = b.start_sentence_id JOIN cleaned z ON z.video_id = b.video_id AND z.sentence_id = b.end_sentence_id WHERE b.start_ms <> a.start_ms OR b.end_ms <> z.end_ms
UNION ALL SELECT s.partition, s.video_id, 'segments.coverage', s.sentence_id FROM spoken s WHERE (SELECT count(*) FROM bent b WHERE b.video_id = s.video_id AND s.sentence_id BETWEEN b.start_sentence_id AND b.end_sentence_id) <> 1
UNION ALL SELECT DISTINCT partition, video_id, 'segments.video', 0 FROM bent WHERE ascii(video_id) % 8 = 3
UNION ALL SELECT partition, video_id, 'segments.content', segment_no FROM held WHERE content <> {R.sql_paragraph('t')}""")
def v3_segment_errors(spark, d):
    bent = _bent(spark, d)
    headers = bent.select(*KEY).distinct().withColumn("id_in_file", F.when(F.ascii("video_id") % 8 == 3, "other").otherwise(F.col("video_id")))
    return validation.segment_faults(R.cleaned(spark, d), bent, headers=headers)


@query(f"WITH {_CATALOG} SELECT '0' AS partition, id AS video_id, CASE WHEN n <= 2 THEN 'stage.cleaned' ELSE 'stage.segments' END AS rule, 0::BIGINT AS pos FROM n WHERE n <= 3")
def v5_missing_stage(spark, d):
    t = _stages(spark, d)
    k = lambda x: t[x].select(F.lit("0").alias("partition"), F.col("id").alias("video_id"))
    return validation.stage_faults(k("raw"), k("cleaned"), k("segments"))


@query("SELECT '0' AS partition, page_id::VARCHAR AS video_id, CASE WHEN contains(url, '?') THEN 'path.empty' ELSE 'path.missing' END AS rule, 0::BIGINT AS pos FROM pages WHERE contains(url, '?') OR contains(url, '#')")
def v4_video_paths(spark, d):
    p = R.table(spark, d, "pages")
    docs = p.select(F.lit("0").alias("partition"), F.col("page_id").cast("string").alias("video_id"), F.when(F.contains("url", F.lit("?")), " ").otherwise(F.concat_ws("#", "url", F.col("page_id").cast("string"))).alias("video_path"))
    files = p.where(~F.contains("url", F.lit("#"))).select(F.concat_ws("#", "url", F.col("page_id").cast("string")).alias("path"))
    return validation.path_faults(docs, files)


_STARTS = """starts AS MATERIALIZED (SELECT partition, video_id, row_number() OVER (PARTITION BY video_id ORDER BY segment_no) AS pos, CASE WHEN segment_no = 1 AND ascii(video_id) % 2 = 0 THEN start_sentence_id + 1 WHEN segment_no = 2 AND ascii(video_id) % 3 = 0 THEN 1000 ELSE start_sentence_id END AS s FROM chapters)"""


@query(f"""WITH RECURSIVE {R.CHAPTERS}, {_STARTS}, x AS (SELECT *, lag(s) OVER (PARTITION BY video_id ORDER BY pos) AS b FROM starts), f AS (SELECT video_id, min(sentence_id) AS first FROM spoken GROUP BY ALL)
SELECT * FROM (SELECT x.video_id, pos, CASE WHEN pos = 1 AND s <> first THEN 'not the first sentence' WHEN sp.sentence_id IS NULL THEN 'unknown sentence' WHEN s <= b THEN 'not rising' END AS fault FROM x JOIN f USING (video_id) LEFT JOIN spoken sp ON sp.video_id = x.video_id AND sp.sentence_id = x.s) WHERE fault IS NOT NULL""")
def v8_boundary_check(spark, d):
    s = segments.nonblank(R.cleaned(spark, d))
    h = F.ascii("video_id")
    starts = R.chapters(spark, d).select(*KEY, F.col("segment_no").alias("pos"), F.when((F.col("segment_no") == 1) & (h % 2 == 0), F.col("start_sentence_id") + 1).when((F.col("segment_no") == 2) & (h % 3 == 0), 1000).otherwise(F.col("start_sentence_id")).alias("start_sentence_id"))
    return segments.boundary_faults(starts, s).select("video_id", "pos", "fault")


@query(f"WITH RECURSIVE {R.CHAPTERS} SELECT video_id, start_sentence_id, CASE WHEN segment_no % 3 = 0 THEN 'no reason' ELSE 'several reasons' END AS fault FROM chapters WHERE segment_no % 3 = 0 OR segment_no % 5 = 0 UNION ALL SELECT video_id, start_sentence_id + 1000, 'no such start' FROM chapters WHERE segment_no = 2 UNION ALL SELECT video_id, NULL, 'no basis' FROM chapters WHERE segment_no = 4")
def v9_explanation_check(spark, d):
    g = R.chapters(spark, d).select(*KEY, "segment_no", "start_sentence_id")
    why = g.select(*KEY, "start_sentence_id", "segment_no", F.when(F.col("segment_no") % 3 == 0, " ").otherwise("because").alias("reason"))
    reasons = why.drop("segment_no").unionByName(why.where("segment_no % 5 = 0 AND segment_no % 3 != 0").drop("segment_no")).unionByName(why.where("segment_no = 2").select(*KEY, (F.col("start_sentence_id") + 1000).alias("start_sentence_id"), "reason"))
    return segments.explanation_faults(reasons, g.select(*KEY, "start_sentence_id"), g.where("segment_no = 4").select(*KEY, F.lit("").alias("overall_basis"))).select("video_id", "start_sentence_id", "fault")


@query(f"WITH RECURSIVE {R.LABELLED} SELECT video_id, segment_no AS position, CASE WHEN segment_no = 2 THEN 'repeated' WHEN segment_no = 3 THEN 'title' WHEN segment_no = 4 THEN 'summary' ELSE 'missing' END AS fault FROM labelled WHERE segment_no BETWEEN 2 AND 5 UNION ALL SELECT video_id, 99, 'unknown' FROM labelled WHERE segment_no = 1")
def v10_label_check(spark, d):
    g = R.labelled(spark, d)
    no = F.col("segment_no")
    lab = g.where(no != 5).select(*KEY, no.alias("position"), F.when(no == 3, F.repeat(F.lit("x"), F.lit(41))).otherwise(F.col("title")).alias("title"), F.when(no == 4, " ").otherwise(F.col("summary")).alias("summary"), "keywords")
    lab = lab.unionByName(lab.where("position = 2")).unionByName(lab.where("position = 1").withColumn("position", F.lit(99).cast("long")))
    return segments.label_faults(lab, g.select(*KEY, no.alias("position"))).select("video_id", "position", "fault")


@query(f"WITH RECURSIVE {R.LABELLED} SELECT video_id, segment_no, CASE WHEN segment_no = 1 THEN 'title' WHEN segment_no = 2 THEN 'content' ELSE 'keywords' END AS fault FROM labelled WHERE segment_no <= 3")
def v12_manual_fields(spark, d):
    no = F.col("segment_no")
    x = R.labelled(spark, d).withColumns({"title": F.when(no == 1, " \n ").otherwise(F.col("title")), "content": F.when(no == 2, "").otherwise(F.col("content")), "keywords": F.when(no == 3, F.array(F.repeat(F.lit("k"), F.lit(25)))).otherwise(F.col("keywords"))})
    return edits.field_faults(x)


# --- glossary

PAIRS = [("queque", "que"), ("ther", "the"), ("les", "la"), ("le", "la"), ("le", "que"), ("on", "ON")]


def _titled(spark, d):
    return R.cleaned(spark, d).withColumn("title", F.left("video_id", F.lit(12)))


def _search_sql() -> str:
    out = R.CLEANED + ",\ns AS MATERIALIZED (SELECT partition, video_id, sentence_id, start_ms, text, []::STRUCT(p BIGINT, n INTEGER)[] AS taken FROM cleaned)"
    last = "s"
    for i, (a, _) in enumerate(PAIRS):
        n = len(a)
        found = f"list_filter(range(1, length(text) + 1), lambda p: text[p:p + {n - 1}] = '{a}')"
        free = f"list_filter({found}, lambda p: len(list_filter(taken, lambda t: p < t.p + t.n AND p + {n} > t.p)) = 0)[1]"
        out += f",\ns{i} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN q{i} IS NULL THEN taken ELSE list_append(taken, {{'p': q{i}::BIGINT, 'n': {n}}}) END AS taken) FROM (SELECT *, {free} AS q{i} FROM {last}))"
        last = f"s{i}"
    hit = " UNION ALL ".join(f"SELECT partition, video_id, sentence_id, start_ms, text, '{a}' AS alias, '{t}' AS term, q{i} - 1 AS k FROM {last} WHERE q{i} IS NOT NULL" for i, (a, t) in enumerate(PAIRS))
    return out + f""",
hits AS MATERIALIZED (SELECT partition, video_id, sentence_id, left(sha256('[' || to_json(partition) || ',' || to_json(video_id) || ',' || sentence_id || ',' || to_json(alias) || ',' || to_json(term) || ',' || to_json(text) || ']'), 24) AS hit_id, left(video_id, 12) AS video_title, start_ms, alias, term, trim(regexp_extract(left(text, k::BIGINT), '([^，,。！？!?；;：:\\n\\r]*)$', 1) || regexp_extract(substr(text, k + 1), '^([^，,。！？!?；;：:\\n\\r]*)', 1)) AS snippet FROM ({hit}))"""


@query(f"WITH {_search_sql()} SELECT * FROM hits")
def g5_search(spark, d):
    return glossary.search(_titled(spark, d), PAIRS)


_WORDS = R.CLEANED + """,
words AS MATERIALIZED (SELECT DISTINCT unnest(regexp_extract_all(raw_text, '[A-Za-z]{3,12}')) AS alias FROM raw),
met AS MATERIALIZED (
  SELECT partition, video_id, sentence_id, start_ms, text, alias, length(alias) AS n, string_split(text, alias) AS parts,
    row_number() OVER (PARTITION BY video_id, sentence_id ORDER BY length(alias) DESC, alias) AS j
  FROM cleaned JOIN words ON contains(text, alias) AND upper(alias) <> alias),
placed AS MATERIALIZED (SELECT * EXCLUDE (parts), list_transform(range(1, len(parts)), lambda i: list_sum(list_transform(parts[1:i], lambda x: length(x)))::BIGINT + (i - 1) * n) AS places FROM met),
walk AS (
  SELECT video_id, sentence_id, 0::BIGINT AS j, []::STRUCT(p BIGINT, n BIGINT)[] AS taken, NULL::BIGINT AS k FROM cleaned
  UNION ALL
  SELECT video_id, sentence_id, j, CASE WHEN q IS NULL THEN taken ELSE list_append(taken, {'p': q, 'n': n::BIGINT}) END, q
  FROM (SELECT w.video_id, w.sentence_id, m.j, m.n, w.taken, list_filter(m.places, lambda p: len(list_filter(w.taken, lambda t: p < t.p + t.n AND p + m.n > t.p)) = 0)[1] AS q
    FROM walk w JOIN placed m ON m.video_id = w.video_id AND m.sentence_id = w.sentence_id AND m.j = w.j + 1)),
found AS MATERIALIZED (SELECT m.*, upper(alias) AS term, k FROM walk JOIN placed m USING (video_id, sentence_id, j) WHERE k IS NOT NULL)"""


def _vocabulary(spark, d):
    """A glossary entry for each word of the recordings."""
    words = R.raw(spark, d).select(F.explode(F.regexp_extract_all("raw_text", F.lit("([A-Za-z]{3,12})"), 1)).alias("alias")).distinct()
    return glossary.pairs_of(words.select(F.lit(0).alias("ord"), F.upper("alias").alias("term"), F.array("alias").alias("aliases")))


@query(f"WITH RECURSIVE {_WORDS} SELECT video_id, sentence_id, alias, term, trim(regexp_extract(left(text, k), '([^，,。！？!?；;：:\\n\\r]*)$', 1) || regexp_extract(substr(text, k + 1), '^([^，,。！？!?；;：:\\n\\r]*)', 1)) AS snippet FROM found")
def j9_search_vocabulary(spark, d):
    """Every word of the recordings is an alias: tens of thousands in one search."""
    return glossary.search(_titled(spark, d), _vocabulary(spark, d)).select("video_id", "sentence_id", "alias", "term", "snippet")


_CHOSEN = "chosen AS MATERIALIZED (SELECT hit_id FROM hits WHERE hit_id < '8')"


def _apply_sql() -> str:
    out, now = _search_sql() + f",\n{_CHOSEN},\npairs AS (SELECT video_id, sentence_id, list(DISTINCT alias || '>' || term) AS pairs FROM hits WHERE hit_id IN (SELECT hit_id FROM chosen) GROUP BY ALL),\ne AS MATERIALIZED (SELECT c.video_id, c.sentence_id, c.text, c.text AS new_text, coalesce(pairs, []) AS pairs FROM cleaned c LEFT JOIN pairs USING (video_id, sentence_id))", "e"
    for i, (a, t) in enumerate(sorted(PAIRS, key=lambda p: (-len(p[0]), p))):
        out += f",\ne{i} AS (SELECT * REPLACE (if(list_contains(pairs, '{a}>{t}'), replace(new_text, '{a}', '{t}'), new_text) AS new_text) FROM {now})"
        now = f"e{i}"
    return out + f",\nedited AS MATERIALIZED (SELECT * FROM {now})"


def _applied(spark, d):
    c = _titled(spark, d)
    hits = glossary.search(c, PAIRS)
    chosen = hits.where("hit_id < '8'").select("hit_id")
    return glossary.apply_hits(c, hits, chosen), chosen


@query(f"WITH {_apply_sql()} SELECT video_id, sentence_id, new_text FROM edited")
def g6_apply(spark, d):
    return _applied(spark, d)[0].select("video_id", "sentence_id", "new_text")


@query(f"WITH {_apply_sql()} SELECT (SELECT count(DISTINCT hit_id) FROM chosen) AS selected, count(*) AS changed_sentences, count(DISTINCT video_id) AS changed_videos FROM edited WHERE new_text <> text")
def a_glossary_counts(spark, d):
    return glossary.applied_counts(*_applied(spark, d))


@query(f"WITH {_search_sql()} SELECT hit_id FROM hits WHERE term = 'ON'")
def j12_stale_hits(spark, d):
    c = _titled(spark, d)
    return glossary.stale(glossary.search(c, PAIRS), glossary.search(c, PAIRS).where("term != 'ON'"))


_UPSERT = """e AS MATERIALIZED (SELECT event_type AS term, event_id, (user_id % 7)::VARCHAR AS u, value < 50 AS old FROM events WHERE event_type <> 'signup' OR value >= 50),
o AS (SELECT term, list(u ORDER BY first) AS a FROM (SELECT term, u, min(event_id) AS first FROM e WHERE old AND u < '5' GROUP BY ALL) GROUP BY term),
w AS (SELECT term, list(u ORDER BY first) AS b FROM (SELECT term, u, min(event_id) AS first FROM e WHERE NOT old AND term <> 'view' GROUP BY ALL) GROUP BY term)"""


@query(f"WITH {_UPSERT}, m AS (SELECT term, coalesce(a, []) AS a, list_concat(coalesce(a, []), list_filter(coalesce(b, []), lambda x: NOT list_contains(coalesce(a, []), x))) AS l, b IS NOT NULL AS given, a IS NULL AS fresh FROM o FULL JOIN w USING (term)) SELECT 'global' AS scope, term, array_to_string(l, '|') AS aliases, given AND (fresh OR l <> a) AS changed FROM m")
def g7_upsert(spark, d):
    e = R.table(spark, d, "events").select(F.lit("global").alias("scope"), F.lit(None).cast("string").alias("video_id"), F.col("event_type").alias("term"), "event_id", (F.col("user_id") % 7).cast("string").alias("u"), (F.col("value") < 50).alias("old"))
    firsts = e.where("old AND u < '5' AND term != 'signup'").groupBy("scope", "video_id", "term", "u").agg(F.min("event_id").alias("f"))
    stored = firsts.groupBy("scope", "video_id", "term").agg(F.transform(F.sort_array(F.collect_list(F.struct("f", "u"))), lambda s: s["u"]).alias("aliases"))
    entries = e.where("NOT old AND term != 'view'").select("scope", "video_id", "term", F.col("event_id").alias("ord"), F.array("u", F.lit(" "), "term").alias("aliases"))
    return glossary.upsert(stored, entries).select("scope", "term", F.array_join("aliases", "|").alias("aliases"), "changed")


@query("""WITH e AS (SELECT user_id::VARCHAR AS video_id, event_type AS term, (user_id % 3)::VARCHAR AS a FROM events GROUP BY ALL) SELECT video_id, term, a AS aliases, CASE WHEN term = 'view' THEN 'global' WHEN term = 'click' THEN 'video' ELSE '' END AS scopes FROM e WHERE NOT (term = 'view' AND a IN ('0', '1')) AND NOT (term = 'click' AND a = '2')""")
def g2_novel(spark, d):
    c = R.table(spark, d, "events").select(F.col("user_id").cast("string").alias("video_id"), F.col("event_type").alias("term"), F.array((F.col("user_id") % 3).cast("string")).alias("aliases")).distinct()
    shared = spark.createDataFrame([("global", None, "view", ["0", "1"])], "scope string, video_id string, term string, aliases array<string>")
    own = c.where("term = 'click'").select(F.lit("video").alias("scope"), "video_id", "term", F.array(F.lit("2")).alias("aliases"))
    return glossary.novel(c, shared.unionByName(own)).select("video_id", "term", F.array_join("aliases", "|").alias("aliases"), F.array_join("existing_scopes", "|").alias("scopes"))


@query("SELECT 'global' AS scope, event_type || '!' AS term, 'term' AS fault FROM events WHERE event_type = 'view' UNION ALL SELECT 'none', event_type, 'scope' FROM events WHERE event_type = 'click' UNION ALL SELECT 'video', event_type, 'alias' FROM events WHERE event_type = 'error'")
def v14_glossary_entries(spark, d):
    t = F.col("event_type")
    return glossary.entry_faults(R.table(spark, d, "events").select(F.when(t == "click", "none").when(t == "error", "video").otherwise("global").alias("scope"), F.when(t == "view", F.concat(t, F.lit("!"))).otherwise(t).alias("term"), F.when(t == "error", F.array(F.lit("a b"))).otherwise(F.array(F.lit(" "), F.lit("ok"))).alias("aliases")))


# --- edits


def _documents(spark, d):
    n = R.table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    i = F.sha2(F.col("conv_id").cast("string"), 256).alias("video_id")
    return n.select(i, F.when(F.col("n") > 3, F.col("n") - 3).otherwise(0).alias("revision"), F.when(F.col("n") > 3, NOW).alias("updated_at"), F.when(F.col("n") == 5, "confirmed").otherwise("pending_review").alias("review_status"), F.when(F.col("n") == 5, NOW).alias("confirmed_at"))


_DOCS = f"docs AS (SELECT sha256(conv_id::VARCHAR) AS video_id, count(*) AS n, CASE WHEN count(*) > 3 THEN count(*) - 3 ELSE 0 END AS revision, CASE WHEN count(*) > 3 THEN '{NOW}' END AS updated_at FROM conversations GROUP BY conv_id)"


@query(f"WITH {_DOCS} SELECT video_id, revision, updated_at FROM docs WHERE (n % 3 = 0 AND revision <> 1) OR (n % 3 = 1 AND updated_at IS NULL) OR (n % 3 = 2 AND revision <> 0)")
def e3_cas_conflicts(spark, d):
    n = R.table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    ask = n.select(F.sha2(F.col("conv_id").cast("string"), 256).alias("video_id"), F.when(F.col("n") % 3 == 0, 1).alias("expected_revision"), F.when(F.col("n") % 3 == 1, NOW).alias("expected_updated_at"))
    return edits.conflicts(_documents(spark, d), ask)


@query(f"WITH {_DOCS} SELECT video_id, revision + CASE WHEN n > 4 THEN 1 ELSE 0 END AS revision, CASE WHEN n > 4 THEN 'now' ELSE updated_at END AS updated_at, 'pending_review' AS review_status, NULL::VARCHAR AS confirmed_at FROM docs")
def e4_touched(spark, d):
    some = R.table(spark, d, "conversations").where("turn = 4").select(F.sha2(F.col("conv_id").cast("string"), 256).alias("video_id"))
    return edits.touched(_documents(spark, d), some, F.lit("now")).select("video_id", F.col("revision").cast("long").alias("revision"), "updated_at", "review_status", "confirmed_at")


@query(f"WITH {R.CLEANED} SELECT video_id, sentence_id, CASE WHEN sentence_id % 3 = 0 THEN replace(text, 'e', 'E') || ' ' ELSE text END AS text FROM cleaned")
def e1_replace_sentences(spark, d):
    c = R.cleaned(spark, d)
    return edits.replace_sentences(c, c.where("sentence_id % 3 = 0").withColumn("text", F.concat(F.replace("text", F.lit("e"), F.lit("E")), F.lit(" ")))).select("video_id", "sentence_id", "text")


@query(f"WITH {R.CLEANED} SELECT DISTINCT video_id FROM cleaned WHERE sentence_id = 4")
def j17_same_rows(spark, d):
    c = R.cleaned(spark, d)
    return edits.same_rows(c, c.withColumn("pos", F.when(F.col("sentence_id") == 4, -1).otherwise(F.col("sentence_id"))).select(*KEY, "pos", "sentence_id")).select("video_id")


@query(f"""WITH RECURSIVE {R.CHAPTERS}, after AS (SELECT * REPLACE (CASE WHEN sentence_id % 2 = 0 THEN replace(text, 'e', 'E') ELSE text END AS text) FROM cleaned),
h AS (SELECT c.video_id, c.segment_no, string_agg(a.text, chr(10) ORDER BY a.sentence_id) FILTER ({R.sql_strip('a.text')} <> '') AS lines, string_agg(a.text, '' ORDER BY a.sentence_id) AS rows FROM chapters c JOIN after a ON a.video_id = c.video_id AND a.sentence_id BETWEEN c.start_sentence_id AND c.end_sentence_id GROUP BY ALL)
SELECT video_id, segment_no, CASE WHEN segment_no % 2 = 1 THEN {R.sql_paragraph('rows')} ELSE {R.sql_paragraph('lines')} END AS content FROM h""")
def j7_manual_override(spark, d):
    c = R.cleaned(spark, d)
    g = R.chapters(spark, d).drop("joined")
    plain = edits.contents(c, g).select(*KEY, "segment_no", "by_row")
    manual = F.col("segment_no") % 2 == 1
    g = g.join(plain, [*KEY, "segment_no"]).withColumn("content", F.when(manual, F.col("by_row")).otherwise(F.col("content"))).withColumn("manual", manual).drop("by_row")
    after = c.withColumn("text", F.when(F.col("sentence_id") % 2 == 0, F.replace("text", F.lit("e"), F.lit("E"))).otherwise(F.col("text")))
    return edits.rebuild(c, after, g).select("video_id", "segment_no", "content")


@query(f"WITH RECURSIVE {R.LABELLED} SELECT video_id, segment_no, trim(regexp_replace(trim(title), '^\\d+[.、]\\s*', '')) AS title, {R.sql_paragraph('summary')} AS summary, {R.sql_paragraph('content')} AS content FROM labelled")
def e6_markdown_fields(spark, d):
    m = segments.chapter_markdown(*(F.col(c) for c in ("title", "summary", "keywords", "start_ms", "end_ms", "content")))
    return R.labelled(spark, d).select("video_id", "segment_no", edits.chapter_of_markdown(m).alias("f")).select("video_id", "segment_no", "f.title", "f.summary", "f.content")


def _changes(spark, d):
    x = cleanup.changes(R.decided(spark, d)).withColumnRenamed("id", "sentence_id")
    asks = F.col("status") == "pending_review"
    none = F.lit(None).cast("string")
    return x.withColumns({"decision": F.when(asks & (F.col("sentence_id") % 2 == 0), "auto_approved").when(asks, "pending").otherwise(""), "approved_text": none, "glossary_review_pending": F.lit(None).cast("boolean"), "decided_at": none, "glossary_reviewed_at": none})


_CHANGES = R.DECIDED + """,
changes AS MATERIALIZED (SELECT *, id AS sentence_id, CASE WHEN status <> 'pending_review' THEN '' WHEN id % 2 = 0 THEN 'auto_approved' ELSE 'pending' END AS decision FROM decided WHERE status = 'pending_review' OR proposed_text <> raw_text)"""


@query(f"WITH {_CHANGES}, v AS (SELECT video_id, count(*) FILTER (decision = 'auto_approved') AS a, count(*) FILTER (decision = 'pending') AS p FROM changes GROUP BY ALL) SELECT video_id, CASE WHEN a > 0 THEN 'auto_approved=' || a ELSE '' END AS decisions, a + p AS pending FROM v")
def a_dec(spark, d):
    text = F.array_join(F.transform(F.map_entries("decisions"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")
    return edits.decision_counts(_changes(spark, d)).select("video_id", text.alias("decisions"), "pending")


@query(f"WITH {_CHANGES} SELECT video_id, sentence_id, CASE WHEN hit THEN 'confirmed_by_video' ELSE was END AS decision, CASE WHEN hit THEN '{NOW}' END AS decided_at FROM (SELECT *, status = 'pending_review' AND ascii(video_id) % 2 = 0 AND sentence_id % 5 > 2 AS hit, CASE sentence_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'approved' ELSE decision END AS was FROM changes)")
def e7_confirm(spark, d):
    c = _changes(spark, d)
    k = F.col("sentence_id") % 5
    c = c.withColumn("decision", F.when(k == 1, "").when(k == 2, "approved").when(k > 2, F.col("decision")))
    some = c.where(F.ascii("video_id") % 2 == 0).select("video_id")
    return edits.confirm(c, _documents(spark, d), some, F.lit(NOW))[0].select("video_id", "sentence_id", "decision", "decided_at")


@query(f"WITH {_DOCS} SELECT video_id, CASE WHEN n > 6 OR n = 5 THEN 'confirmed' ELSE 'pending_review' END AS review_status, (revision + CASE WHEN n > 6 THEN 1 ELSE 0 END)::BIGINT AS revision FROM docs")
def e7_confirmed_documents(spark, d):
    some = R.table(spark, d, "conversations").where("turn = 6").select(F.sha2(F.col("conv_id").cast("string"), 256).alias("video_id"))
    return edits.confirm(_changes(spark, d), _documents(spark, d), some, F.lit(NOW))[1].select("video_id", "review_status", F.col("revision").cast("long").alias("revision"))


@query(f"""WITH {_CHANGES} SELECT video_id, sentence_id, CASE WHEN status <> 'pending_review' THEN '' WHEN sentence_id % 3 = 0 THEN 'rejected' ELSE 'approved' END AS decision,
CASE WHEN status <> 'pending_review' THEN effective_text WHEN sentence_id % 3 = 0 THEN {R.sql_paragraph('raw_text')} WHEN sentence_id % 3 = 1 THEN 'my own' ELSE {R.sql_paragraph('proposed_text')} END AS effective_text, CASE WHEN status = 'pending_review' THEN sentence_id % 3 = 1 END AS glossary_review_pending FROM changes""")
def e8_decide(spark, d):
    c = _changes(spark, d)
    i = F.col("sentence_id") % 3
    say = c.where("status = 'pending_review'").select("video_id", "sentence_id", F.when(i == 0, "rejected").otherwise("approved").alias("decision"), F.when(i == 1, " my own ").alias("approved_text"))
    return edits.decide_suggestions(c, say, F.lit(NOW)).select("video_id", "sentence_id", "decision", "effective_text", "glossary_review_pending")


@query(f"WITH {_CHANGES} SELECT video_id, sentence_id, CASE WHEN status = 'pending_review' THEN NOT (sentence_id % 3 = 1 AND sentence_id <= 3) AND sentence_id % 3 = 1 END AS open_ FROM changes")
def e9_glossary_reviewed(spark, d):
    c = _changes(spark, d)
    i = F.col("sentence_id") % 3
    say = c.where("status = 'pending_review'").select("video_id", "sentence_id", F.when(i == 0, "rejected").otherwise("approved").alias("decision"), F.when(i == 1, "my own").alias("approved_text"))
    chapter = c.select("video_id", F.lit(1).alias("start_sentence_id"), F.lit(3).alias("end_sentence_id")).distinct()
    return edits.glossary_reviewed(edits.decide_suggestions(c, say, F.lit(NOW)), chapter, F.lit(NOW)).select("video_id", "sentence_id", F.col("glossary_review_pending").alias("open_"))


@query("SELECT conv_id, turn, CASE WHEN contains(text, ' que ') THEN left(text, strpos(text, ' que ') - 1) || 'Q' || substr(text, strpos(text, ' que ') + 5) WHEN contains(text, ' the ') THEN left(text, strpos(text, ' the ') - 1) || 'Q' || substr(text, strpos(text, ' the ') + 5) ELSE text END AS text FROM conversations")
def e11_merge_editor(spark, d):
    some = F.array(F.lit(None).cast("string"), F.lit(""), F.lit(" que "), F.lit(" the "))
    return R.table(spark, d, "conversations").select("conv_id", "turn", edits.merge_open_editor(F.col("text"), some, F.lit("Q")).alias("text"))


@query("WITH e AS (SELECT user_id AS job_id, event_id AS pos, CASE WHEN value > 200 THEN 'failed' ELSE 'completed' END AS status FROM events), f AS (SELECT *, min(pos) FILTER (status = 'failed') OVER (PARTITION BY job_id) AS first FROM e) SELECT job_id, pos, CASE WHEN pos > first THEN 'cancelled' ELSE status END AS status FROM f")
def st6_failure_cancels(spark, d):
    return jobs.after_failures(R.table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("pos"), F.when(F.col("value") > 200, "failed").otherwise("completed").alias("status")))


@query("WITH e AS (SELECT user_id AS job_id, event_type AS t FROM events) SELECT job_id, CASE WHEN count(*) FILTER (t = 'error') > 0 THEN 'failed' ELSE 'completed' END AS status FROM e GROUP BY job_id")
def st6_job_states(spark, d):
    return jobs.job_states(R.table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status")))


@query("SELECT event_id AS job_id, CASE event_type WHEN 'view' THEN 'interrupted' WHEN 'click' THEN 'interrupted' ELSE 'completed' END AS after_restart, CASE WHEN event_type = 'view' THEN CASE WHEN value > 50 THEN 'cancelled' ELSE 'queued' END WHEN event_type = 'click' THEN CASE WHEN value > 50 THEN 'cancelling' ELSE 'running' END ELSE 'completed' END AS after_cancel FROM events")
def src12_restart_and_cancel(spark, d):
    e = R.table(spark, d, "events")
    j = e.select(F.col("event_id").alias("job_id"), F.when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "click", "running").otherwise("completed").alias("status"))
    ask = e.where("value > 50").select(F.col("event_id").alias("job_id"))
    return jobs.restarted(j).withColumnRenamed("status", "after_restart").join(jobs.cancelled(j, ask).withColumnRenamed("status", "after_cancel"), "job_id")
