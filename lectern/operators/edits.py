"""Edits of published documents (E1-E11) as DataFrame transformations; what they return is committed by lectern.sources.store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions.diffs import redistributed
from lectern.operators import intervals
from lectern.operators.segments import KEY, KEYWORD, SUMMARY, TITLE, ordered_text


def conflicts(documents: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (video_id, expected_revision, expected_updated_at) whose page is stale.

    Asking without either is allowed only for a document that was never edited.
    """
    x = requests.join(documents.select("video_id", F.coalesce("revision", F.lit(0)).alias("revision"), "updated_at"), "video_id")
    asked, when = F.col("expected_revision"), F.nullif("expected_updated_at", F.lit(""))
    blind = asked.isNull() & when.isNull() & ((F.col("revision") != 0) | F.nullif("updated_at", F.lit("")).isNotNull())
    return x.where((asked != F.col("revision")) | (when.isNotNull() & ~when.eqNullSafe(F.col("updated_at"))) | blind).select("video_id", "revision", "updated_at")


def field_faults(fields: DataFrame) -> DataFrame:
    """Manual chapter fields that must be refused."""
    n = lambda c: F.length(X.paragraph(F.col(c)))
    word = F.exists("keywords", lambda k: ~F.length(X.paragraph(k)).between(1, KEYWORD))
    fault = F.when(~n("title").between(1, TITLE), "title").when(~n("summary").between(1, SUMMARY), "summary").when(n("content") == 0, "content").when(word, "keywords")
    return fields.select("video_id", "segment_no", fault.alias("fault")).where("fault IS NOT NULL")


def same_rows(cleaned: DataFrame, edited: DataFrame) -> DataFrame:
    """Videos whose edit does not name the same sentences in the same order; edited: keys, pos, sentence_id."""
    ids = lambda t, o: t.groupBy(*KEY).agg(F.transform(F.sort_array(F.collect_list(F.struct(o, F.col("sentence_id").alias("s")))), lambda r: r["s"]).alias("ids"))
    e = ids(edited, "pos").withColumnRenamed("ids", "given")
    return e.join(ids(cleaned, "sentence_id"), KEY, "left").where(~F.col("ids").eqNullSafe(F.col("given"))).select(*KEY)


def replace_sentences(cleaned: DataFrame, edited: DataFrame) -> DataFrame:
    """Texts replaced as they are, ids and times kept."""
    new = edited.select(*KEY, "sentence_id", F.col("text").alias("new_text"), F.lit(True).alias("edited"))
    return cleaned.join(new, [*KEY, "sentence_id"], "left").withColumn("text", F.when(F.col("edited"), F.coalesce("new_text", F.lit(""))).otherwise(F.col("text"))).drop("new_text", "edited")


def _held(cleaned: DataFrame, segments: DataFrame) -> DataFrame:
    """The sentences of each segment."""
    c = cleaned.select(*KEY, "sentence_id", F.coalesce("text", F.lit("")).alias("text"), F.col("start_ms").alias("s_start"), F.col("end_ms").alias("s_end"))
    g = segments.select(*KEY, "segment_no", "start_sentence_id", "end_sentence_id")
    return intervals.pairs(c, g, KEY, "sentence_id", "start_sentence_id", "end_sentence_id").select(*KEY, "segment_no", "sentence_id", "text", "s_start", "s_end")


def contents(cleaned: DataFrame, segments: DataFrame) -> DataFrame:
    """Per segment the content by lines and by plain joining, and the times of its anchors; blank rows stay anchors."""
    h = _held(cleaned, segments).withColumn("line", F.when(~X.is_blank(F.col("text")), F.col("text")))
    return h.groupBy(*KEY, "segment_no").agg(X.paragraph(ordered_text("sentence_id", "line", "\n")).alias("by_line"), X.paragraph(ordered_text("sentence_id", "text", "")).alias("by_row"), F.min_by("s_start", "sentence_id").alias("new_start"), F.max_by("s_end", "sentence_id").alias("new_end"))


def rebuild(before: DataFrame, after: DataFrame, segments: DataFrame) -> DataFrame:
    """Segments rebuilt from changed sentences; a manual chapter that was its sentences plainly joined stays so."""
    old = contents(before, segments).select(*KEY, "segment_no", F.col("by_row").alias("old_row"))
    new = contents(after, segments)
    x = segments.join(old, [*KEY, "segment_no"], "left").join(new, [*KEY, "segment_no"], "left")
    manual = F.coalesce("manual", F.lit(False))
    plain = manual & (X.paragraph(F.col("content")) == F.col("old_row"))
    return x.withColumns({"content": F.when(plain, F.col("by_row")).otherwise(F.col("by_line")), "start_ms": F.coalesce("new_start", "start_ms"), "end_ms": F.coalesce("new_end", "end_ms")}).select(segments.columns)


def touched(documents: DataFrame, videos: DataFrame, now: Column) -> DataFrame:
    """Every edit: revision + 1, back to pending review, no confirmation; documents of other videos stay."""
    x = documents.join(videos.select("video_id").distinct().withColumn("hit", F.lit(True)), "video_id", "left")
    put = lambda c, v: F.when(F.col("hit"), v).otherwise(F.col(c))
    return x.withColumns({"revision": put("revision", F.coalesce("revision", F.lit(0)) + 1), "review_status": put("review_status", F.lit("pending_review")), "updated_at": put("updated_at", now), "confirmed_at": put("confirmed_at", F.lit(None).cast("string"))}).select(documents.columns)


def save_chapter(cleaned: DataFrame, segments: DataFrame, edit: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cleaned, segments) after chapter edits (keys, segment_no, title, summary, keywords, content).

    The chapter's text is cut over its own sentences; the manual flag rises if the
    content changed and never falls.
    """
    own = edit.select(*KEY, "segment_no", X.paragraph(F.col("title")).alias("n_title"), X.paragraph(F.col("summary")).alias("n_summary"), F.array_distinct(F.transform("keywords", X.paragraph)).alias("n_keywords"), X.paragraph(F.col("content")).alias("n_content"))
    h = _held(cleaned, segments.join(own.select(*KEY, "segment_no"), [*KEY, "segment_no"], "left_semi"))
    rows = h.groupBy(*KEY, "segment_no").agg(F.sort_array(F.collect_list(F.struct("sentence_id", X.paragraph(F.col("text")).alias("t")))).alias("rows")).join(own.select(*KEY, "segment_no", "n_content"), [*KEY, "segment_no"])
    cut = rows.withColumn("parts", redistributed(F.transform("rows", lambda r: r["t"]), F.col("n_content")))
    edited = cut.select(*KEY, F.explode(F.arrays_zip(F.transform("rows", lambda r: r["sentence_id"]).alias("i"), F.col("parts"))).alias("x")).select(*KEY, F.col("x.i").alias("sentence_id"), F.col("x.parts").alias("text"))
    x = segments.join(own.withColumn("hit", F.lit(True)), [*KEY, "segment_no"], "left")
    put = lambda c: F.when(F.col("hit"), F.col(f"n_{c}")).otherwise(F.col(c))
    manual = F.coalesce("manual", F.lit(False)) | F.coalesce(F.col("hit") & (F.col("n_content") != X.paragraph(F.col("content"))), F.lit(False))
    return replace_sentences(cleaned, edited), x.withColumns({"manual": manual, **{c: put(c) for c in ("title", "summary", "keywords", "content")}}).select(segments.columns)


def chapter_of_markdown(markdown: Column) -> Column:
    """struct(title, summary, content, keywords) of a chapter's Markdown; null parts are missing ones."""
    title = F.regexp_replace(F.regexp_extract(markdown, r"(?m)^##[ \t]+(.+?)[ \t]*$", 1), r"^\d+[.、]\s*", "")
    summary = F.regexp_extract(markdown, r"(?ms)^###\s+章节摘要\s*$\s*(.*?)(?=^###\s+章节正文\s*$)", 1)
    content = F.regexp_extract(markdown, r"(?ms)^###\s+章节正文\s*$\s*(.*)\z", 1)
    words = F.regexp_extract(markdown, r"(?m)^>[ \t]*关键词[：:][ \t]*(.*?)[ \t]*$", 1)
    filled = lambda c: F.nullif(c, F.lit(""))
    return F.struct(filled(F.trim(title)).alias("title"), filled(X.paragraph(summary)).alias("summary"), filled(X.paragraph(content)).alias("content"), X.keywords(words).alias("keywords"))


def decide_suggestions(changes: DataFrame, decisions: DataFrame, now: Column) -> DataFrame:
    """Pending changes with a decision (video_id, sentence_id, decision, approved_text): effective text, approved text, and whether a custom text still needs the glossary's review."""
    x = changes.join(decisions.select("video_id", "sentence_id", F.col("decision").alias("n_decision"), F.col("approved_text").alias("n_text")), ["video_id", "sentence_id"], "left")
    hit = F.col("n_decision").isin("approved", "rejected") & (F.col("status") == "pending_review")
    proposed = X.paragraph(X.first_filled(F.col("proposed_text"), F.col("raw_text")))
    yes = F.col("n_decision") == "approved"
    text = F.when(yes, X.paragraph(X.first_filled(F.col("n_text"), F.col("proposed_text"), F.col("raw_text")))).otherwise(X.paragraph(F.col("raw_text")))
    put = lambda c, v: F.when(hit, v).otherwise(F.col(c))
    return x.withColumns({"decision": put("decision", F.col("n_decision")), "effective_text": put("effective_text", text), "approved_text": put("approved_text", F.when(yes, text)), "glossary_review_pending": put("glossary_review_pending", yes & F.col("n_text").isNotNull() & (text != proposed)), "decided_at": put("decided_at", now)}).select(changes.columns)


def decision_counts(changes: DataFrame) -> DataFrame:
    """A-DEC: per video the decisions that occur, and pending ones with the provisional."""
    n = lambda d: F.count_if((F.col("status") == "pending_review") & (F.col("decision") == d))
    kinds = ("approved", "rejected", "auto_approved", "confirmed_by_video")
    m = F.create_map(*(x for k in kinds for x in (F.lit(k), n(k))))
    return changes.groupBy("video_id").agg(F.map_filter(m, lambda k, v: v > 0).alias("decisions"), (n("pending") + n("auto_approved")).alias("pending"))


def snapshots(changes: DataFrame, cleaned: DataFrame, videos: DataFrame, now: Column) -> DataFrame:
    """(keys, counts, decisions, final, updated_at) for those of the videos that have an audit: decisions that occur, how many of each, and the sentences as they are now."""
    n = lambda d: F.count_if((F.col("status") == "pending_review") & (F.col("decision") == d))
    kinds = ("approved", "rejected", "auto_approved", "confirmed_by_video")
    made = lambda of: F.create_map(*(x for k, v in of.items() for x in (F.lit(k), v)))
    own = lambda t: t.join(videos.select("video_id").distinct(), "video_id", "left_semi")
    told = own(changes).groupBy(*KEY).agg(made({k: n(k) for k in kinds} | {"pending_review": n("pending") + n("auto_approved")}).alias("counts"), F.map_filter(made({k: n(k) for k in kinds}), lambda k, v: v > 0).alias("decisions"))
    final = own(cleaned).groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("sentence_id", "start_ms", "end_ms", "text"))).alias("final"))
    return told.join(final, KEY, "left").select(*KEY, "counts", "decisions", "final", now.alias("updated_at"))


def confirm(changes: DataFrame, documents: DataFrame, videos: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(changes, documents) after videos are confirmed: pending suggestions that are open or approved for the time being count as confirmed with the video; whatever else was decided, or never asked, stays."""
    ids = videos.select("video_id").distinct().withColumn("hit", F.lit(True))
    c = changes.join(ids, "video_id", "left")
    open_ = F.col("hit") & (F.col("status") == "pending_review") & F.col("decision").isin("pending", "auto_approved")
    c = c.withColumns({"decision": F.when(open_, "confirmed_by_video").otherwise(F.col("decision")), "decided_at": F.when(open_, now).otherwise(F.col("decided_at"))}).select(changes.columns)
    d = documents.join(ids, "video_id", "left")
    put = lambda k, v: F.when(F.col("hit"), v).otherwise(F.col(k))
    d = d.withColumns({"review_status": put("review_status", F.lit("confirmed")), "confirmed_at": put("confirmed_at", now), "updated_at": put("updated_at", now), "revision": put("revision", F.coalesce("revision", F.lit(0)) + 1)}).select(documents.columns)
    return c, d


def glossary_reviewed(changes: DataFrame, chapters: DataFrame, now: Column) -> DataFrame:
    """Custom approved texts inside saved chapters (video_id, start_sentence_id, end_sentence_id) need no glossary review any more."""
    c, g = changes.select("video_id", "sentence_id"), chapters.select("video_id", "start_sentence_id", "end_sentence_id")
    inside = intervals.pairs(c, g, ["video_id"], "sentence_id", "start_sentence_id", "end_sentence_id").select("video_id", "sentence_id").distinct().withColumn("hit", F.lit(True))
    x = changes.join(inside, ["video_id", "sentence_id"], "left")
    approved = X.paragraph(F.col("approved_text"))
    custom = F.col("hit") & (F.col("decision") == "approved") & (approved != "") & (approved != X.paragraph(X.first_filled(F.col("proposed_text"), F.col("raw_text")))) & F.coalesce("glossary_review_pending", F.lit(True))
    return x.withColumns({"glossary_review_pending": F.when(custom, False).otherwise(F.col("glossary_review_pending")), "glossary_reviewed_at": F.when(custom, now).otherwise(F.col("glossary_reviewed_at"))}).select(changes.columns)


def merge_open_editor(text: Column, candidates: Column, effective: Column) -> Column:
    """The first candidate that the open text holds is replaced once."""
    first = F.get(F.filter(candidates, lambda c: F.coalesce((c != "") & F.contains(text, c), F.lit(False))), F.lit(0))
    return F.when(first.isNotNull(), F.overlay(text, effective, F.instr(text, first), F.length(first))).otherwise(text)
