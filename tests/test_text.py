"""Text functions against small rules written anew, and the reference literals."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lectern.functions import diffs
from lectern.functions import text as X
from lectern.operators import alignment, cleanup, edits, jobs


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'long' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("text,n", [("案件 A-1，保存。\n", 6), ("", 0), (" \t\n", 0), ("a+b<c$", 6), ("…—!?", 0)])
def test_effective_length(spark, text, n):
    assert one(spark, X.effective_length(F.col("t")), t=text) == n


def paragraph(text):
    out = ""
    for line in (" ".join(x.split()) for x in text.replace("\r", "").split("\n")):
        if line:
            out += (" " if out and re.match(r"[A-Za-z0-9,.;:!?)]", out[-1]) and re.match(r"[A-Za-z0-9(]", line) else "") + line
    return out


def test_random_texts(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab 1(),.!?\n\r\t案，。 　é") for _ in range(rng.randrange(40))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    t = F.col("t")
    for r in df.select("i", X.paragraph(t).alias("p"), X.effective_length(t).alias("n"), X.collapse(t).alias("c"), X.is_blank(t).alias("b"), X.alignment_key(t).alias("k")).collect():
        s = texts[r.i]
        assert r.p == paragraph(s)
        assert r.n == sum(not c.isspace() and unicodedata.category(c)[0] != "P" for c in s)
        assert r.c == " ".join(s.split())
        assert r.b == (not s.strip())
        assert r.k == alignment.lexical(s)


@pytest.mark.parametrize("ms,code", [(0, "0:00"), (-5, "0:00"), (59_999, "0:59"), (61_000, "1:01"), (3_600_000, "1:00:00"), (36_610_000, "10:10:10")])
def test_timecode(spark, ms, code):
    assert one(spark, X.timecode(F.col("m")), m=ms) == code


@pytest.mark.parametrize("name,title,safe", [("a/b__0123456789abcdef.mp4", "b", "b__0123456789abcdef.mp4"), ("x.tar.gz", "x.tar", "x.tar.gz"), ("a<b>:.mp4. ", "a<b>:.mp4", "a_b__.mp4"), ("", "", "video.mp4"), ("...", "..", "video.mp4")])
def test_names(spark, name, title, safe):
    assert one(spark, X.safe_filename(F.col("n")), n=name) == safe
    if name not in ("...", "a<b>:.mp4. "):
        assert one(spark, X.title_from_filename(F.col("n")), n=name) == title


def test_clause_snippet(spark):
    assert one(spark, X.snippet(F.col("t"), F.lit(6)), t="前文，由省管办负责。后文") == "由省管办负责"


@pytest.mark.parametrize("line,ok", [('PIPELINE_PROGRESS {"stage":"asr","completed":7,"total":10,"detail":" x "}', True), ("PIPELINE_PROGRESS {bad", False), ("other", False), ('PIPELINE_PROGRESS {"stage":"asr","completed":1,"total":0}', False)])
def test_progress_lines(spark, line, ok):
    e = one(spark, jobs.parsed(F.col("l")), l=line)
    assert (e is not None) == ok
    if ok:
        assert (e.stage, round(e.fraction, 6), e.detail) == ("asr", 0.7, "x")


@pytest.mark.parametrize("answer,ok", [('```json\n{"a": 1}\n```', True), ("[1]", False), ("no", False), ('{"a": }', False), (' {"a": 1} ', True), ('{"a": 1}\n```', False), ('```json\n{"a": 1}\n``` more', True), ('```json\n{"a": 1}', True), ('```{"a": 1}```', False), ('```\n{"a": "```"}\n```', True), (None, False)])
def test_json_object(spark, answer, ok):
    assert (one(spark, cleanup.json_object(F.col("a")), a=answer) is not None) == ok


def test_similarity_and_terms():
    assert diffs.ratio("tide", "diet") == 0.25 and diffs.ratio("diet", "tide") == 0.5
    assert diffs.ratio("。", "abc") == 0
    assert [(c["term"], c["aliases"]) for c in diffs.candidate_terms("兔南海沈文婷", "通达海沈文婷")] == [("通达海", ["兔南海"])]
    assert [(c["term"], c["aliases"]) for c in diffs.candidate_terms("专网的COCO群", "专网的CoCall群")] == [("CoCall", ["COCO"])]


def test_redistribution_keeps_the_text():
    rng = random.Random(3)
    for _ in range(300):
        parts = ["".join(rng.choice("abc ") for _ in range(rng.randrange(6))) for _ in range(rng.randrange(1, 5))]
        new = "".join(rng.choice("abcd ") for _ in range(rng.randrange(15)))
        got = diffs.redistribute(parts, new)
        assert "".join(got) == new and len(got) == len(parts)
    assert diffs.redistribute(["请兔南海介绍。", "第二句保持。"], "请通达海介绍。第二句保持。") == ["请通达海介绍。", "第二句保持。"]
    assert diffs.redistribute(["ab", "cd"], "abXcd") == ["ab", "Xcd"]  # inserted at a border: the row after it


def test_markdown_fields(spark):
    md = "## 3. 标题 \n\n> 关键词：甲、乙，无，甲\n\n### 章节摘要\n\n摘要。\n\n### 章节正文\n\n正文一\n正文二\n"
    f = one(spark, edits.chapter_of_markdown(F.col("m")), m=md)
    assert (f.title, f.summary, f.content, f.keywords) == ("标题", "摘要。", "正文一正文二", ["甲", "乙"])


def test_editor_merge_replaces_once(spark):
    assert one(spark, edits.merge_open_editor(F.col("t"), F.array(F.lit(""), F.lit("b")), F.lit("X")), t="abab") == "aXab"
