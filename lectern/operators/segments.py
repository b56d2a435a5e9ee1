"""Chapters over ordered sentences: offsets, ranges, content, labels and their Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators.batching import greedy_batches

KEY = ["partition", "video_id"]
#: Most characters of a title, a summary and a keyword; marks that part keywords in a model's answer.
TITLE, SUMMARY, KEYWORD = 40, 160, 24
LABEL_MARKS = r"[,，、;；\n]+"


def nonblank(cleaned: DataFrame) -> DataFrame:
    """Stripped texts of the sentences that are not blank."""
    return cleaned.where(~X.is_blank(F.col("text"))).withColumn("text", X.strip(F.col("text")))


def sentence_faults(cleaned: DataFrame) -> DataFrame:
    """P1's checks: (partition, video_id, sentence_id, fault) where ids do not rise strictly or times are not in order."""
    w = W.partitionBy(*KEY).orderBy("pos")
    before = cleaned.select("*", F.lag("sentence_id").over(w).alias("b_id"), F.lag("start_ms").over(w).alias("b_start"))
    fault = F.when(F.col("sentence_id") <= F.col("b_id"), "ids do not rise").when((F.col("start_ms") < 0) | (F.col("end_ms") <= F.col("start_ms")) | (F.col("start_ms") < F.col("b_start")), "times out of order")
    return before.select(*KEY, "sentence_id", fault.alias("fault")).where("fault IS NOT NULL")


def char_offsets(sentences: DataFrame) -> DataFrame:
    """Running effective characters [start_char, end_char) in sentence order."""
    n = X.effective_length(F.col("text"))
    end = F.sum("n_chars").over(W.partitionBy(*KEY).orderBy("sentence_id").rowsBetween(W.unboundedPreceding, 0))
    return sentences.withColumn("n_chars", n).withColumn("end_char", end).withColumn("start_char", F.col("end_char") - F.col("n_chars"))


def payload(sentences: DataFrame) -> DataFrame:
    """Per video the compact JSON rows [id, start, end, text] and the total."""
    o = char_offsets(sentences)
    row = F.concat(F.lit("["), F.concat_ws(",", F.col("sentence_id").cast("string"), F.col("start_char").cast("string"), F.col("end_char").cast("string"), X.json_text(F.col("text"))), F.lit("]"))
    return o.groupBy(*KEY).agg(F.count("*").alias("sentence_count"), F.max("end_char").alias("total_chars"), F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sentence_id", row.alias("r")))), lambda s: s["r"]), ","), F.lit("]")).alias("sentences"))


def greedy_starts(sentences: DataFrame, limit: int) -> DataFrame:
    """A deterministic stand-in for a model's boundaries: (keys, sentence_id of each start) by effective characters up to limit."""
    sized = sentences.select(*KEY, "sentence_id", X.effective_length(F.col("text")).alias("size"))
    return greedy_batches(sized, KEY, "sentence_id", "size", 1 << 30, limit).groupBy(*KEY, "batch").agg(F.min("sentence_id").alias("start_sentence_id")).drop("batch")


def ranges(sentences: DataFrame, starts: DataFrame) -> DataFrame:
    """Each sentence with the 1-based number of its range; an end is the sentence before the next start by position, not by id."""
    marks = starts.select(*KEY, F.col("start_sentence_id").alias("sentence_id"), F.lit(1).alias("is_start"))
    w = W.partitionBy(*KEY).orderBy("sentence_id").rowsBetween(W.unboundedPreceding, 0)
    return sentences.join(marks, [*KEY, "sentence_id"], "left").withColumn("segment_no", F.sum(F.coalesce("is_start", F.lit(0))).over(w)).drop("is_start").where("segment_no > 0")


def materialise(numbered: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """R10, J3, A-CONT: segments with anchors, times and content of numbered sentences; labels (keys, position, title, summary, keywords) if given."""
    out = numbered.groupBy(*KEY, "segment_no").agg(F.min("sentence_id").alias("start_sentence_id"), F.max("sentence_id").alias("end_sentence_id"), F.min_by("start_ms", "sentence_id").alias("start_ms"), F.max_by("end_ms", "sentence_id").alias("end_ms"), ordered_text("sentence_id", "text", "\n").alias("joined")).withColumn("content", X.paragraph(F.col("joined")))
    if labels is None:
        return out
    return out.drop("joined").join(labels.withColumnRenamed("position", "segment_no"), [*KEY, "segment_no"])


def ordered_text(order: str, text: str, mark: str) -> Column:
    """Aggregate: texts joined in order."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, F.col(text).alias("t")))), lambda s: s["t"]), mark)


def label_batches(segments: DataFrame, most: int = 6, chars: int = 12_000) -> DataFrame:
    """Batches of ranges for one labelling request each."""
    sized = segments.select(*KEY, "segment_no", F.length("joined").cast("long").alias("size"))
    return greedy_batches(sized, KEY, "segment_no", "size", most, chars)


def stand_in_labels(segments: DataFrame) -> DataFrame:
    """Deterministic labels by content: its beginning as title and summary, first distinct words as keywords."""
    words = F.filter(F.split("content", "[ \\n]+"), lambda w: (w != "") & (F.length(w) <= KEYWORD))
    return segments.select(*KEY, F.col("segment_no").alias("position"), F.trim(F.left("content", F.lit(TITLE))).alias("title"), F.trim(F.left("content", F.lit(SUMMARY))).alias("summary"), F.slice(F.array_distinct(words), 1, 5).alias("keywords"))


def clean_keywords(raw: Column) -> Column:
    """V10, A-KW: of a model's keywords (array) the distinct ones of 1 to 24 characters, stripped; others are dropped silently."""
    return F.array_distinct(F.filter(F.transform(raw, X.strip), lambda k: k.isNotNull() & (k != "") & (F.length(k) <= KEYWORD)))


def label_faults(labels: DataFrame, expected: DataFrame) -> DataFrame:
    """(keys, position, fault) for labels that are unknown, repeated, badly sized or missing.  keywords may be a string column."""
    counted = labels.withColumn("copies", F.count("*").over(W.partitionBy(*KEY, "position")))
    known = expected.select(*KEY, "position", F.lit(True).alias("known"))
    size = lambda c, most: ~F.length(X.strip(F.coalesce(c, F.lit("")))).between(1, most)
    fault = F.when(F.col("known").isNull(), "unknown").when(F.col("copies") > 1, "repeated").when(size(F.col("title"), TITLE), "title").when(size(F.col("summary"), SUMMARY), "summary")
    wrong = counted.join(known, [*KEY, "position"], "left").select(*KEY, "position", fault.alias("fault")).where("fault IS NOT NULL").distinct()
    missing = expected.select(*KEY, "position").join(labels.select(*KEY, "position"), [*KEY, "position"], "left_anti").select("*", F.lit("missing").alias("fault"))
    return wrong.unionByName(missing)


def boundary_faults(starts: DataFrame, sentences: DataFrame) -> DataFrame:
    """V8: (keys, pos, fault) of proposed starts (keys, pos, start_sentence_id): the first must be the first sentence, all must exist and rise."""
    ids = sentences.select(*KEY, F.col("sentence_id").alias("start_sentence_id"), F.lit(True).alias("there"))
    first = sentences.groupBy(*KEY).agg(F.min("sentence_id").alias("first_id"))
    w = W.partitionBy(*KEY).orderBy("pos")
    x = starts.withColumn("before", F.lag("start_sentence_id").over(w)).join(first, KEY, "left").join(ids, [*KEY, "start_sentence_id"], "left")
    fault = F.when((F.col("pos") == 1) & (F.col("start_sentence_id") != F.col("first_id")), "not the first sentence").when(F.col("there").isNull(), "unknown sentence").when(F.col("start_sentence_id") <= F.col("before"), "not rising")
    wrong = x.select(*KEY, "pos", fault.alias("fault")).where("fault IS NOT NULL")
    none = first.join(starts.select(*KEY), KEY, "left_anti").select(*KEY, F.lit(0).cast("long").alias("pos"), F.lit("no start").alias("fault"))
    return wrong.unionByName(none)


def explained_starts(reasons: DataFrame, starts: DataFrame) -> DataFrame:
    """(keys, same): whether exactly the starts are explained."""
    ids = lambda t, name: t.groupBy(*KEY).agg(F.sort_array(F.collect_set("start_sentence_id")).alias(name))
    return ids(starts, "a").join(ids(reasons, "b"), KEY, "full_outer").select(*KEY, F.col("a").eqNullSafe(F.col("b")).alias("same"))


def explanation_faults(reasons: DataFrame, starts: DataFrame, basis: DataFrame) -> DataFrame:
    """V9: (keys, start_sentence_id, fault): exactly one non-blank reason for each start, and a non-blank overall basis (id null)."""
    on = [*KEY, "start_sentence_id"]
    filled = reasons.where(~X.is_blank(F.col("reason")))
    n = filled.groupBy(*on).agg(F.count("*").alias("n"))
    none = starts.select(*on).join(n, on, "left_anti").select(*on, F.lit("no reason").alias("fault"))
    many = n.where("n > 1").select(*on, F.lit("several reasons").alias("fault"))
    odd = reasons.select(*on).distinct().join(starts.select(*on), on, "left_anti").select(*on, F.lit("no such start").alias("fault"))
    bare = basis.where(X.is_blank(F.col("overall_basis"))).select(*KEY, F.lit(None).cast("long").alias("start_sentence_id"), F.lit("no basis").alias("fault"))
    return none.unionByName(many).unionByName(odd).unionByName(bare)


def explanations(reasons: DataFrame) -> DataFrame:
    """V9: stripped reasons, at most 600 characters."""
    return reasons.withColumn("reason", F.left(X.strip(F.col("reason")), F.lit(600)))


def _block(title: Column, quote: list[Column], parts: list[tuple[str, Column]]) -> Column:
    lines = [F.concat(F.lit("## "), title), F.lit(""), *quote]
    for name, body in parts:
        lines += [F.lit(""), F.lit(f"### {name}"), F.lit(""), body]
    return F.concat_ws("\n", *lines, F.lit(""))


def chapter_markdown(title: Column, summary: Column, keywords: Column, start_ms: Column, end_ms: Column, content: Column) -> Column:
    """The preview of one chapter."""
    words = F.array_join(F.filter(F.transform(F.coalesce(keywords, F.array().cast("array<string>")), X.strip), lambda k: k != ""), "、")
    return _block(X.strip(X.first_filled(title, F.lit("未命名章节"))), [F.concat(F.lit("> 时间："), X.timecode(start_ms), F.lit("–"), X.timecode(end_ms)), F.concat(F.lit("> 关键词："), X.first_filled(words, F.lit("无")))], [("章节摘要", X.paragraph(summary)), ("章节正文", X.paragraph(content))])


def document_markdown(segments: DataFrame, titles: DataFrame) -> DataFrame:
    """(keys, markdown) of whole documents; titles (keys, title) may have videos without segments."""
    words = F.array_join(F.filter(F.transform(F.coalesce("keywords", F.array().cast("array<string>")), X.inline), lambda k: k != ""), "、")
    quote = [F.concat(F.lit("> 时间："), X.timecode(F.col("start_ms")), F.lit("–"), X.timecode(F.col("end_ms")), F.lit("  ")), F.concat(F.lit("> 句子："), F.col("start_sentence_id").cast("string"), F.lit("–"), F.col("end_sentence_id").cast("string")), F.when(words != "", F.concat(F.lit("> 关键词："), words))]
    name = F.concat(F.col("segment_no").cast("string"), F.lit(". "), X.first_filled(X.inline(F.col("title")), F.concat(F.lit("片段 "), F.col("segment_no").cast("string"))))
    body = _block(name, quote, [("摘要", X.first_filled(X.paragraph(F.col("summary")), F.lit("（无）"))), ("正文", X.first_filled(X.paragraph(F.col("content")), F.lit("（无）")))])
    rows = segments.select(*KEY, "segment_no", body.alias("body")).groupBy(*KEY).agg(F.count("*").alias("n"), ordered_text("segment_no", "body", "\n").alias("body"))
    head = F.concat(F.lit("# "), X.first_filled(X.inline(F.col("title")), F.lit("未命名视频")), F.lit("\n\n> 视频 ID：`"), F.col("video_id"), F.lit("`  \n> 片段数："), F.coalesce("n", F.lit(0)).cast("string"), F.lit("\n\n"))
    whole = F.concat(head, F.coalesce("body", F.lit("")))
    return titles.join(rows, KEY, "left").select(*KEY, F.concat(F.regexp_replace(whole, r"(?U)\s+\z", ""), F.lit("\n")).alias("markdown"))
