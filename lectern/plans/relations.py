"""The engine's relations, derived from the general test tables, in Spark and in DuckDB SQL.

A conversation is a recording, a turn a sentence whose time comes from its length;
a deterministic rule stands in for the cleanup model, and a greedy rule over
effective characters for the chaptering model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import batching, cleanup, segments

KEY = segments.KEY
#: Effective characters of a chapter, limits of a cleanup batch and of a labelling batch.
CHAPTER, BATCH, LABELS = 1_200, (40, 3_800), (6, 12_000)
_S = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def raw(spark: SparkSession, d: str) -> DataFrame:
    """partition, video_id, id, start_ms, end_ms, raw_text."""
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    n = (10 * F.length("text") + 1).cast("long")
    x = table(spark, d, "conversations").select("conv_id", "turn", "text", n.alias("n")).withColumn("end_ms", F.sum("n").over(w)).withColumn("id", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")).cast("long"))
    return x.select((F.col("conv_id") % 3).cast("string").alias("partition"), F.sha2(F.col("conv_id").cast("string"), 256).alias("video_id"), "id", (F.col("end_ms") - F.col("n")).alias("start_ms"), "end_ms", F.col("text").alias("raw_text"))


def proposals(raw_rows: DataFrame) -> DataFrame:
    asks = F.col("raw_text").rlike("[0-9]")
    return raw_rows.select(*KEY, "id", X.collapse(F.col("raw_text")).alias("proposed"), asks.alias("needs_review"), F.when(asks, "has a digit").otherwise("").alias("review_reason"))


def decided(spark: SparkSession, d: str) -> DataFrame:
    r = raw(spark, d)
    return cleanup.decide(r, proposals(r))


def cleaned(spark: SparkSession, d: str) -> DataFrame:
    """partition, video_id, sentence_id, start_ms, end_ms, text."""
    return cleanup.provisional(decided(spark, d))


def numbered(spark: SparkSession, d: str) -> DataFrame:
    s = segments.nonblank(cleaned(spark, d))
    return segments.ranges(s, segments.greedy_starts(s, CHAPTER))


def chapters(spark: SparkSession, d: str) -> DataFrame:
    """partition, video_id, segment_no, anchors, times, joined, content."""
    return segments.materialise(numbered(spark, d))


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """The chapters with title, summary, keywords and manual."""
    g = chapters(spark, d)
    lab = segments.stand_in_labels(g).withColumnRenamed("position", "segment_no")
    return g.drop("joined").join(lab, [*KEY, "segment_no"]).withColumn("manual", F.lit(False))


def sql_strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_S}+|{_S}+$', '', 'g')"


def sql_collapse(c: str) -> str:
    return f"trim(regexp_replace({c}, '{_S}+', ' ', 'g'))"


def sql_effective(c: str) -> str:
    return f"length(regexp_replace({c}, '{_S.replace('[', '[' + chr(92) + 'pP', 1)}', '', 'g'))"


def sql_paragraph(c: str) -> str:
    line = _S.replace(r"\s", r"\t\f\r ", 1)
    t = f"regexp_replace(replace(coalesce({c}, ''), chr(13), ''), '{line}+', ' ', 'g')"
    t = f"regexp_replace(regexp_replace({t}, ' *\\n[ \\n]*', chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g')"
    for _ in range(2):  # no look-around: neighbouring joins share a character
        t = f"regexp_replace({t}, '([A-Za-z0-9,.;:!?)])\\n([A-Za-z0-9(])', '\\1 \\2', 'g')"
    return f"replace({t}, chr(10), '')"


def sql_timecode(c: str) -> str:
    s = f"greatest(0, coalesce({c}, 0) // 1000)"
    return f"CASE WHEN {s} >= 3600 THEN ({s} // 3600) || ':' || lpad((({s} % 3600) // 60)::VARCHAR, 2, '0') ELSE ({s} // 60)::VARCHAR END || ':' || lpad(({s} % 60)::VARCHAR, 2, '0')"


RAW = """raw AS MATERIALIZED (SELECT (conv_id % 3)::VARCHAR AS partition, sha256(conv_id::VARCHAR) AS video_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS id, (sum(10 * length(text) + 1) OVER w)::BIGINT - (10 * length(text) + 1) AS start_ms, (sum(10 * length(text) + 1) OVER w)::BIGINT AS end_ms, text AS raw_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))"""
DECIDED = RAW + f""",
decided AS MATERIALIZED (SELECT *, CASE WHEN asks THEN 'pending_review' WHEN proposed_text = raw_text THEN 'unchanged' ELSE 'auto_accepted' END AS status, CASE WHEN asks THEN raw_text ELSE proposed_text END AS effective_text, CASE WHEN asks THEN 'has a digit' ELSE '' END AS review_reason FROM (SELECT *, {sql_collapse('raw_text')} AS proposed_text, regexp_matches(raw_text, '[0-9]') AS asks FROM raw))"""
CLEANED = DECIDED + """,
cleaned AS MATERIALIZED (SELECT partition, video_id, id AS sentence_id, start_ms, end_ms, CASE WHEN status = 'pending_review' THEN coalesce(nullif(proposed_text, ''), nullif(raw_text, ''), '') ELSE effective_text END AS text FROM decided)"""
SPOKEN = CLEANED + f""",
spoken AS MATERIALIZED (SELECT * REPLACE ({sql_strip('text')} AS text) FROM cleaned WHERE {sql_strip('text')} <> '')"""


def sql_greedy(name: str, source: str, order: str, size: str, items: int, most: int) -> str:
    """A table `name` of (video_id, order, batch) by the greedy rule."""
    return f"""{name}_in AS MATERIALIZED (SELECT video_id, {order}, {size} AS size, row_number() OVER (PARTITION BY video_id ORDER BY {order}) AS rn FROM {source}),
{name} AS (SELECT video_id, {order}, rn, 1 AS n, size::BIGINT AS c, 0::BIGINT AS batch FROM {name}_in WHERE rn = 1
UNION ALL SELECT s.video_id, s.{order}, s.rn, CASE WHEN f.n >= {items} OR f.c + s.size > {most} THEN 1 ELSE f.n + 1 END, CASE WHEN f.n >= {items} OR f.c + s.size > {most} THEN s.size ELSE f.c + s.size END, f.batch + CASE WHEN f.n >= {items} OR f.c + s.size > {most} THEN 1 ELSE 0 END FROM {name} f JOIN {name}_in s ON s.video_id = f.video_id AND s.rn = f.rn + 1)"""


CHAPTERS = SPOKEN + ",\n" + sql_greedy("fold", "spoken", "sentence_id", sql_effective("text"), 1 << 30, CHAPTER) + f""",
numbered AS MATERIALIZED (SELECT s.*, f.batch + 1 AS segment_no FROM spoken s JOIN fold f USING (video_id, sentence_id)),
joined AS (SELECT partition, video_id, segment_no, min(sentence_id) AS start_sentence_id, max(sentence_id) AS end_sentence_id, arg_min(start_ms, sentence_id) AS start_ms, arg_max(end_ms, sentence_id) AS end_ms, string_agg(text, chr(10) ORDER BY sentence_id) AS joined FROM numbered GROUP BY ALL),
chapters AS MATERIALIZED (SELECT *, {sql_paragraph('joined')} AS content FROM joined)"""
LABELLED = CHAPTERS + """,
worded AS (SELECT *, list_filter(string_split_regex(content, '[ \\n]+'), lambda w: w <> '' AND length(w) <= 24) AS words FROM chapters),
labelled AS MATERIALIZED (SELECT * EXCLUDE (joined, words), trim(content[1:40]) AS title, trim(content[1:160]) AS summary, list_filter(words, lambda w, i: list_position(words, w) = i)[1:5] AS keywords FROM worded)"""
