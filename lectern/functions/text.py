"""Text functions as Spark columns.  "Blank" means white space only, by Unicode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters after and before which a joined line keeps a space, invalid file-name characters, list and clause marks.
SPACE_AFTER, SPACE_BEFORE = r"[A-Za-z0-9,.;:!?)]", r"[A-Za-z0-9(]"
INVALID_NAME = r'[<>:"/\\|?*\x00-\x1f]'
KEYWORD_MARKS = r"[,，、;；]+"
CLAUSE_MARKS = "，,。！？!?；;：:\n\r"
TERM = r"[㐀-鿿A-Za-z0-9·_-]+"
SENTENCE_ENDS = r"[。！？!?]+|\.(?=\s|$)"
_SPACE = r"\s\x1c-\x1f"


def strip(c: Column) -> Column:
    """Without leading and trailing Unicode white space."""
    return F.regexp_replace(c, rf"(?U)^[{_SPACE}]+|[{_SPACE}]+\z", "")


def is_blank(c: Column) -> Column:
    return F.length(strip(F.coalesce(c, F.lit("")))) == 0


def collapse(c: Column) -> Column:
    """Runs of white space become one space, ends are stripped."""
    return F.trim(F.regexp_replace(c, rf"(?U)[{_SPACE}]+", " "))


def effective_length(c: Column) -> Column:
    """Code points that are neither white space nor punctuation (symbols count)."""
    return F.length(F.regexp_replace(c, rf"(?U)[\p{{P}}{_SPACE}]", "")).cast("long")


def paragraph(c: Column) -> Column:
    """Lines joined into one paragraph, with a space only between Latin words."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), "\r", "")
    t = F.regexp_replace(t, rf"(?U)[{_SPACE}&&[^\n]]+", " ")
    t = F.regexp_replace(t, r" *\n[ \n]*", "\n")
    t = F.regexp_replace(t, r"^[ \n]+|[ \n]+\z", "")
    t = F.regexp_replace(t, rf"(?<={SPACE_AFTER})\n(?={SPACE_BEFORE})", " ")
    return F.regexp_replace(t, "\n", "")


def timecode(ms: Column) -> Column:
    """M:ss, or h:mm:ss from an hour on; null and negative count as 0."""
    s = F.greatest(F.lit(0), F.floor(F.coalesce(ms, F.lit(0)) / 1000)).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    h, m, sec = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), two(m), F.lit(":"), two(sec))).otherwise(F.concat(F.floor(s / 60).cast("string"), F.lit(":"), two(sec)))


def duration(start_ms: Column, end_ms: Column) -> Column:
    """T4: time code of the length, never negative."""
    return timecode(F.greatest(F.lit(0), end_ms - start_ms))


def inline(c: Column) -> Column:
    """T5: line breaks become spaces, ends are stripped; null is empty."""
    return strip(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "\r", " "), r"[\n\x0b\f\x1c-\x1e\u0085\u2028\u2029]", " "))


def base_name(path: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(path, "/+$", ""), "([^/]*)$", 1)


def stem(name: Column) -> Column:
    """A file name without its last suffix; a leading dot starts no suffix."""
    return F.regexp_replace(name, r"(?s)^(.+)\.[^./]+$", "$1")


def title_from_filename(path: Column) -> Column:
    """The stem without a closing __ and 16 hex digits."""
    return F.regexp_replace(stem(base_name(path)), r"(?s)^(.*)__[0-9a-fA-F]{16}$", "$1")


def upload_title(name: Column) -> Column:
    """As T9, but a stem that is all hash stays; null is empty."""
    s = stem(strip(base_name(F.coalesce(name, F.lit("")))))
    return F.coalesce(F.nullif(F.regexp_replace(s, r"__[0-9a-fA-F]{16}$", ""), F.lit("")), s)


def safe_filename(name: Column) -> Column:
    """Base name with invalid characters replaced; video.mp4 if nothing is left."""
    n = F.coalesce(F.nullif(name, F.lit("")), F.lit("video.mp4"))
    v = F.regexp_replace(F.regexp_replace(strip(base_name(n)), INVALID_NAME, "_"), "[. ]+$", "")
    return F.coalesce(F.nullif(v, F.lit("")), F.lit("video.mp4"))


def short_error(c: Column, default: str = "model response could not be used") -> Column:
    """Collapsed, at most 240 characters, never empty."""
    return F.coalesce(F.nullif(F.left(collapse(F.coalesce(c, F.lit(""))), F.lit(240)), F.lit("")), F.lit(default))


def term_parts(c: Column) -> Column:
    """Runs of Han, Latin, digits, middle dot, underscore and hyphen."""
    return F.regexp_extract_all(c, F.lit(f"({TERM})"), 1)


def is_term(c: Column) -> Column:
    """1 to 40 characters, all of a term."""
    return c.rlike(f"^{TERM}\\z") & F.length(c).between(1, 40)


def keywords(c: Column) -> Column:
    """Distinct keywords of a manual edit, in order, without blanks and the word for none."""
    parts = F.transform(F.split(c, KEYWORD_MARKS), strip)
    return F.array_distinct(F.filter(parts, lambda k: (k != "") & (k != "无")))


def dot_position(start_ms: Column, total_ms: Column) -> Column:
    """Percent of the whole, clamped to 0..100; 0 without a length."""
    return F.when(total_ms > 0, F.least(F.lit(100.0), F.greatest(F.lit(0.0), start_ms * 100.0 / total_ms))).otherwise(0.0)


def suggestion_label(decision: Column) -> Column:
    """What the review page says about a decision."""
    return F.when(decision == "approved", "approved").when(decision == "rejected", "rejected").when(decision == "auto_approved", "applied provisionally").when(decision == "confirmed_by_video", "confirmed with the video").otherwise("pending")


def first_filled(*cols: Column) -> Column:
    """T22 and titles: the first value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cols))


def alignment_key(c: Column) -> Column:
    """A4: lower-cased letters and digits."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}㐀-鿿]", ""))


def aligner_text(c: Column) -> Column:
    """A5: a space after each sentence end, so that an aligner does not join words across it."""
    return F.regexp_replace(c, f"({SENTENCE_ENDS})", "$1 ")


def valid_id(c: Column) -> Column:
    """64 hex digits, case ignored."""
    return F.coalesce(F.lower(c).rlike(r"^[0-9a-f]{64}\z"), F.lit(False))


def json_text(c: Column) -> Column:
    """A string as a JSON literal."""
    j = F.to_json(F.array(c))
    return F.substring(j, F.lit(2), F.length(j) - 2)


def evened(text: Column) -> Column:
    """A text of the same length with line breaks for its clause marks; of texts that hold many hits, to be made once."""
    return F.translate(text, CLAUSE_MARKS, "\n" * len(CLAUSE_MARKS))


def clause(even: Column, position: Column) -> Column:
    """G3 for an evened text."""
    left, right = F.substring_index(F.left(even, position), "\n", -1), F.substring_index(F.substring(even, position + 1, F.length(even)), "\n", 1)
    return strip(F.concat(left, right))


def snippet(text: Column, position: Column) -> Column:
    """The clause around a 0-based position, stripped."""
    return clause(evened(text), position)


def hit_id(*parts: Column) -> Column:
    """The first 24 hex digits of SHA-256 of the compact JSON array of the parts; numbers stay bare."""
    return F.left(F.sha2(F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]")), 256), F.lit(24))


#: Fixed value: models of this name and its variants always think, and take a level.
LEVELLED = "glm-5.3"


def reasoning(model: Column, thinking: Column) -> Column:
    """struct(thinking, effort) of a request: models with levels think at a high or low one, others are switched on or off and have none."""
    levels = F.startswith(F.lower(strip(F.coalesce(model, F.lit("")))), F.lit(LEVELLED))
    on = F.coalesce(thinking, F.lit(False))
    return F.struct(F.when(levels | on, "enabled").otherwise("disabled").alias("thinking"), F.when(levels, F.when(on, "high").otherwise("low")).alias("effort"))
