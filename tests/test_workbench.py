"""End to end over a store: search, apply, decide, save, confirm, delete, with stale pages and invalid edits."""

import json
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from lectern.job_log import JobLog
from lectern.operators import cleanup, jobs, responder
from lectern.sources.store import ConflictError, Store
from lectern.workbench import Workbench

V = ("2026-09", "a" * 64)
RAWS = ["第一句旧词。", "第二句。", "Hello", "world."]


@pytest.fixture
def bench(spark, tmp_path):
    times = [(i * 1000, i * 1000 + 900) for i in range(4)]
    raw = spark.createDataFrame([(*V, i + 1, *t, x) for i, (t, x) in enumerate(zip(times, RAWS))], "partition string, video_id string, id long, start_ms long, end_ms long, raw_text string")
    cleaned = raw.toDF("partition", "video_id", "sentence_id", "start_ms", "end_ms", "text")
    seg = spark.createDataFrame([(*V, 1, "一", "摘要", ["k"], 1, 2, 0, 1900, "第一句旧词。第二句。", False), (*V, 2, "二", "摘要", ["k"], 3, 4, 2000, 3900, "Hello world.", False)], "partition string, video_id string, segment_no long, title string, summary string, keywords array<string>, start_sentence_id long, end_sentence_id long, start_ms long, end_ms long, content string, manual boolean")
    docs = spark.createDataFrame([(*V, "题", "pending_review", 0, None, None)], "partition string, video_id string, title string, review_status string, revision long, updated_at string, confirmed_at string")
    changes = spark.createDataFrame([(*V, 2, "第二句。", "建议。", "第二句。", "pending_review", "pending", None, None, None, None)], "partition string, video_id string, sentence_id long, raw_text string, proposed_text string, effective_text string, status string, decision string, approved_text string, glossary_review_pending boolean, decided_at string, glossary_reviewed_at string")
    s = Store(spark, str(tmp_path / "store"))
    s.commit({"raw": raw, "cleaned": cleaned, "segments": seg, "documents": docs, "changes": changes, "uploads": spark.createDataFrame([("b" * 64, "new__0123456789abcdef.mp4", "2026")], "id string, filename string, uploaded_at string")}, 0)
    return Workbench(s, lambda: "now")


def contents(b):
    return [r.content for r in b.store.table("segments").orderBy("segment_no").collect()]


def test_dashboard(bench):
    counts, rows = bench.dashboard()
    assert [(r.title, r.review_status) for r in rows.collect()] == [("new", "not_ready"), ("题", "pending_review")]
    assert counts.first().asDict() == {"videos": 2, "uploaded": 1, "raw": 1, "cleaned": 1, "segments": 1, "business": 0, "pending_review": 1, "completed": 0}
    assert bench.validate().count() == 0 and "## 2. 二" in bench.markdown(V[1])


def test_search_apply_and_conflict(bench):
    hits = [r.hit_id for r in bench.search_glossary([("新词", ["旧词"])]).collect()]
    assert bench.apply_glossary([("新词", ["旧词"])], hits) == {"selected": 1, "changed_sentences": 1, "changed_videos": 1}
    assert contents(bench) == ["第一句新词。第二句。", "Hello world."]
    with pytest.raises(ConflictError):
        bench.apply_glossary([("新词", ["旧词"])], hits)
    d = bench.store.table("documents").first()
    assert (d.revision, d.updated_at, d.review_status) == (1, "now", "pending_review") and bench.validate().count() == 0


def test_decide_and_confirm(bench):
    bench.decide(V[1], 2, "approved", "自己的。")
    row = bench.store.table("changes").first()
    assert (row.decision, row.approved_text, row.glossary_review_pending) == ("approved", "自己的。", True)
    assert contents(bench)[0] == "第一句旧词。自己的。"
    for args, error in (((V[1], 9, "approved"), KeyError), ((V[1], 2, "maybe"), ValueError)):
        with pytest.raises(error):
            bench.decide(*args)
    bench.confirm(V[1])
    assert bench.store.table("documents").first().review_status == "confirmed"
    with pytest.raises(KeyError):
        bench.confirm("none")


def test_chapters(bench):
    fields = {"title": "新题", "summary": "s", "keywords": ["a", "a"], "content": "Hello my world."}
    bench.save_chapter(V[1], 2, fields)
    assert [r.text for r in bench.store.table("cleaned").orderBy("sentence_id").collect()][2:] == ["Hello", " my world."]
    for more, error in (({}, ConflictError), ({"expected_revision": 0}, ConflictError)):
        with pytest.raises(error):
            bench.save_chapter(V[1], 2, fields, **more)
    with pytest.raises(ValueError):
        bench.save_chapter(V[1], 2, fields | {"title": "x" * 41}, expected_revision=1)
    with pytest.raises(KeyError):
        bench.save_chapter(V[1], 7, fields, expected_revision=1)
    bench.save_markdown(V[1], 1, "## 1. 甲\n\n> 关键词：无\n\n### 章节摘要\n\n乙\n\n### 章节正文\n\n丙丁\n", expected_revision=1)
    assert contents(bench) == ["丙丁", "Hello my world."]
    bench.save_sentences(V[1], {1: "改。"})
    with pytest.raises(KeyError):
        bench.save_sentences(V[1], {99: "x"})


def test_terms_and_delete(bench):
    assert bench.save_terms([("global", None, "词", ["此"])]) == 1 and bench.save_terms([("global", None, "词", ["此"])]) == 0
    with pytest.raises(ValueError):
        bench.save_terms([("global", None, "a b", [])])
    assert bench.delete(V[1]) == 4 + 4 + 2 + 1 + 1
    assert bench.store.table("cleaned").count() == 0


def planner(starts, labels=None):
    def respond(prompt, attempt, error):
        p = json.loads(prompt)
        if "sentences" in p:
            return json.dumps({"start_sentence_ids": starts})
        return json.dumps(labels or {"labels": [{"position": s["position"], "title": f"t{s['position']}", "summary": "s", "keywords": "案件概览，案件趋势", "extra": 1} for s in p["fixed_segments"]]})

    return respond


def test_chapter_plans(spark):
    ids, texts, offs = [1, 2, 5, 9], list("abcd"), [(0, 1), (1, 2), (2, 3), (3, 4)]
    plan = responder.plan_video("t", ids, texts, offs, planner([1, 5]))
    assert [(s["start_sentence_id"], s["end_sentence_id"], s["text"], s["title"], s["keywords"]) for s in plan] == [(1, 2, "a\nb", "t1", ["案件概览", "案件趋势"]), (5, 9, "c\nd", "t2", ["案件概览", "案件趋势"])]
    for bad in ([2], [1, 1], [1, 7], [], [True], ["x"], [1, 1.5]):
        with pytest.raises(ValueError):
            responder.plan_video("t", ids, texts, offs, planner(bad))
    with pytest.raises(ValueError):
        responder.plan_video("t", ids, texts, offs, planner([1, 5], {"labels": [{"position": 1, "title": "a", "summary": "b", "keywords": []}]}))
    with pytest.raises(ValueError):
        responder.plan_video("t", [1], ["x" * 130_000], [(0, 130_000)], planner([1]))
    df = spark.createDataFrame([("p", "v", i, t, a, b) for i, t, (a, b) in zip(ids, texts, offs)] + [("p", "w", 1, "x", 0, 1)], "partition string, video_id string, sentence_id long, text string, start_char long, end_char long")
    got = responder.plan_videos(df, planner([1, 5])).collect()
    assert sorted((r.video_id, r.position or 0) for r in got) == [("v", 1), ("v", 2), ("w", 0)] and [bool(r.error) for r in got if r.video_id == "w"] == [True]
    assert responder.chapter_metadata("x", planner([]))["title"] == "t1"
    with pytest.raises(ValueError):
        responder.chapter_metadata(" ", planner([]))


def test_history_follows_the_edits(bench):
    bench.decide(V[1], 2, "approved")
    h = bench.store.table("history").first()
    assert h.decisions == {"approved": 1} and h.counts["approved"] == 1 and h.counts["pending_review"] == 0
    assert [s.text for s in h.final] == ["第一句旧词。", "建议。", "Hello", "world."]
    bench.save_sentences(V[1], {1: "新。"})
    assert [s.text for s in bench.store.table("history").first().final][:2] == ["新。", "建议。"]
    bench.confirm(V[1])
    assert bench.store.table("history").first().decisions == {"approved": 1}


def test_confirming_needs_valid_sentences(bench, spark):
    at = bench.store.pointer()
    bench.store.commit({"cleaned": bench.store.table("cleaned").withColumn("start_ms", F.when(F.col("sentence_id") == 2, F.col("start_ms") + 1).otherwise(F.col("start_ms")))}, at["revision"])
    with pytest.raises(ValueError, match="cleaned.anchor"):
        bench.confirm(V[1])


def test_chapters_bring_terms_and_reviews(bench):
    bench.decide(V[1], 2, "approved", "通达海办的。")
    found = {r.term: r.aliases for r in bench.candidates(V[1], 1, "## 1. 一\n\n### 章节摘要\n\n摘要\n\n### 章节正文\n\n第一句 NewTerm。通达海办的。\n").collect()}
    assert "NewTerm" in found and len(found) == 2
    with pytest.raises(KeyError):
        bench.candidates(V[1], 9, "")
    bench.save_chapter(V[1], 1, {"title": "一", "summary": "摘要", "keywords": ["k"], "content": "第一句旧词。通达海办的。"}, expected_revision=1, terms=[("global", None, "通达海", ["第二"])])
    row = bench.store.table("changes").first()
    assert row.glossary_review_pending is False and row.glossary_reviewed_at == "now"
    assert bench.store.table("glossary").first().term == "通达海"
    assert bench.metadata(V[1], 1, "x", planner([]))["title"] == "t1"
    with pytest.raises(ValueError):
        bench.save_chapter(V[1], 1, {"title": "一", "summary": "摘要", "keywords": ["k"], "content": "x"}, expected_revision=2, terms=[("global", None, "a b", [])])
    assert bench.store.table("documents").first().revision == 2


def test_one_video(bench):
    row = bench.video(V[1]).first()
    assert row.record.title == "题" and [r.id for r in row.raw.rows] == [1, 2, 3, 4] and len(row.segments.rows) == 2
    assert row.suggestions.sentence_ids == [2] and row.markdown.markdown == bench.markdown(V[1])
    with pytest.raises(KeyError):
        bench.video("none")


def test_publishing_a_cleanup(bench, spark):
    w = ("2026-09", "d" * 64)
    raw = spark.createDataFrame([(*w, 1, 0, 5, "a 1"), (*w, 2, 5, 9, "b  c")], "partition string, video_id string, id long, start_ms long, end_ms long, raw_text string")
    s = bench.store
    s.commit({"raw": s.table("raw").unionByName(raw)}, 1)
    proposals = spark.createDataFrame([(*w, 1, "A 1", True, "why"), (*w, 2, "b c", False, "")], "partition string, video_id string, id long, proposed string, needs_review boolean, review_reason string")
    decided = cleanup.decide(raw, proposals)
    with pytest.raises(ConflictError, match="changed"):
        bench.publish_cleanup(raw.withColumn("raw_text", F.concat("raw_text", F.lit("x"))), decided)
    with pytest.raises(ValueError, match="cleaned.count"):
        bench.publish_cleanup(raw, decided.where("id = 1"))
    bench.publish_cleanup(raw, decided)
    mine = F.col("video_id") == w[1]
    assert [r.text for r in s.table("cleaned").where(mine).orderBy("sentence_id").collect()] == ["A 1", "b c"]
    assert [(r.sentence_id, r.decision, r.effective_text) for r in s.table("changes").where(mine).orderBy("sentence_id").collect()] == [(1, "pending", "A 1"), (2, None, "b c")]
    assert s.table("cleaned").count() == 6 and s.table("history").where(mine).first().counts["pending_review"] == 1
    with pytest.raises(ConflictError, match="audit"):
        bench.publish_cleanup(raw, decided, overwrite=True)
    s.commit({"changes": s.table("changes").where(~mine)}, s.pointer()["revision"])
    with pytest.raises(ConflictError, match="meanwhile"):
        bench.publish_cleanup(raw, decided)
    bench.publish_cleanup(raw, decided, overwrite=True)


def test_explanations_are_written_once(bench, spark):
    make = lambda t: spark.createDataFrame([(V[1], t)], "video_id string, overall_basis string")
    bench.publish_explanations(make("first"))
    bench.publish_explanations(make("second"))
    assert [(r.overall_basis, r.generated_at) for r in bench.store.table("explanations").collect()] == [("first", "now")]


def test_uploads_by_content(bench, spark):
    make = lambda *rows: spark.createDataFrame(list(rows), "id string, filename string, uploaded_at string")
    bench.add_uploads(make(("b" * 64, "renamed.mp4", "2027"), ("e" * 64, "other.mov", "2026")))
    assert sorted((r.id[0], r.filename) for r in bench.store.table("uploads").collect()) == [("b", "renamed.mp4"), ("e", "other.mov")]
    with pytest.raises(ConflictError):
        bench.add_uploads(make(("e" * 16 + "f" * 48, "other.MOV", "2028")))


def test_edits_touch_their_leaf_only(bench, spark):
    s = bench.store
    many = spark.createDataFrame([("2026-09", f"{i:064d}", 1, 0, 5, "x") for i in range(40)], "partition string, video_id string, sentence_id long, start_ms long, end_ms long, text string")
    s.commit({"cleaned": s.table("cleaned").unionByName(many)}, 1)
    before = s.pointer()["relations"]["cleaned"]["leaves"]
    bench.save_sentences(V[1], {1: "改。"})
    after = s.pointer()["relations"]["cleaned"]["leaves"]
    assert sum(before[b] != after[b] for b in before) == 1 and before.keys() == after.keys()
    assert s.table("cleaned").count() == 44 and s.required("cleaned", V[1]).count() == 4
    with pytest.raises(FileNotFoundError):
        s.required("cleaned", "none")
    s.vacuum()
    assert s.table("cleaned").count() == 44
    with pytest.raises(ValueError, match="not relations"):
        s.commit({"../x": many}, 3)
    bad = {"cleaned": {"leaves": {"0-0": [{"rows": "../../etc", "gone": None, "bytes": 1}]}, "schema": {}}}
    assert s._put(f"{s.root}/_commits/{4:012d}.json", json.dumps({"revision": 4, "relations": bad}))
    with pytest.raises(RuntimeError):
        s.pointer()


def test_dashboard_reads_no_sentences(bench, spark):
    """Counts kept with each commit equal those of the whole relations after edits, new videos and deletions."""
    s, rng = bench.store, random.Random(1)
    text = "partition string, video_id string, sentence_id long, start_ms long, end_ms long, text string"

    def whole(name, **more):
        return {r.video_id: r.asDict() for r in s.table(name).groupBy("video_id").agg(F.count("*").alias("n"), *(F.expr(e).alias(c) for c, e in more.items())).collect()}

    def same():
        kept = lambda n: {r.video_id: r.asDict() for r in s.table(f"{n}_tally").collect()}
        assert kept("raw") == whole("raw", duration_ms="max(end_ms)") and kept("cleaned") == whole("cleaned") and kept("segments") == whole("segments")
        got = {r.id: r for r in bench.records().collect()}
        assert {k: r.sentence_count for k, r in got.items() if r.sentence_count} == {k: r["n"] for k, r in whole("raw").items()}

    same()
    for k in range(5):
        videos = [f"{rng.randrange(4):064d}" for _ in range(2)]
        rows = [("2026-09", v, i, i * 10, i * 10 + 5, "x") for v in set(videos) for i in range(1, rng.randrange(1, 4))]
        cleaned = spark.createDataFrame(rows, text)
        s.commit({"cleaned": cleaned, "raw": cleaned.toDF("partition", "video_id", "id", "start_ms", "end_ms", "raw_text")}, s.pointer()["revision"], spark.createDataFrame([(v,) for v in videos], "video_id string"))
    same()
    bench.delete(V[1])
    same()
    read = {f.split(str(s.root) + "/", 1)[1].split("/")[0] for f in bench.records().inputFiles()}
    assert read <= {"raw_tally", "cleaned_tally", "segments_tally", "changes_tally", "business_tally", "documents", "uploads"}


def test_jobs(bench, spark):
    log, state = JobLog(bench.store, lambda: "now"), lambda j: sorted((r.pos, r.status, r.job_status) for r in log.items().where(F.col("job_id") == j).collect())
    one = spark.createDataFrame([(V[1],)], "video_id string")
    for stage, videos in (("x", [V[1]]), ("cleanup", []), ("cleanup", [V[1], "none"])):
        with pytest.raises(ValueError):
            log.create(stage, videos)
    a = log.create("asr", [V[1], "2", V[1], "3"])
    assert state(a) == [(0, "queued", "queued"), (1, "queued", "queued"), (2, "queued", "queued")]
    for act in (lambda: bench.save_sentences(V[1], {1: "改。"}), lambda: bench.confirm(V[1]), lambda: bench.decide(V[1], 2, "approved"), lambda: bench.delete(V[1]), lambda: bench.save_chapter(V[1], 2, {"title": "t", "summary": "s", "keywords": [], "content": "c"})):
        with pytest.raises(ConflictError, match="a job works"):
            act()
    hits = [r.hit_id for r in bench.search_glossary([("新词", ["旧词"])]).collect()]
    with pytest.raises(ConflictError, match="a job works"):
        bench.apply_glossary([("新词", ["旧词"])], hits)
    log.record(a, 0, "running", "begun ")
    log.record(a, 0, "completed", "ended")
    assert log.busy(one).isEmpty() and [r.log for r in log.items().where("pos = 0").collect()] == ["begun ended"]
    bench.save_sentences(V[1], {1: "改。"})
    log.record(a, 1, "failed")
    assert state(a) == [(0, "completed", "failed"), (1, "failed", "failed"), (2, "cancelled", "failed")]
    with pytest.raises(ValueError):
        log.cancel(a)
    with pytest.raises(KeyError):
        log.cancel("none")
    b = log.create("segments", [V[1]])
    log.record(b, 0, "running")
    log.cancel(b)
    assert state(b) == [(0, "cancelling", "cancelling")] and not log.busy(one).isEmpty()
    log.interrupted()
    assert state(b) == [(0, "interrupted", "interrupted")] and log.busy(one).isEmpty()
    assert [r.job_id for r in jobs.latest(log.items().select("job_id", "seq").distinct(), 1).collect()] == [b]


def test_edits_of_one_process_wait_for_each_other(bench, spark):
    """Sentences, terms and uploads saved at once: all are there, and none ends in a conflict."""
    up = spark.createDataFrame([("f" * 64, "other.mov", "2026")], "id string, filename string, uploaded_at string")
    acts = [lambda: bench.save_sentences(V[1], {1: "改。"}), lambda: bench.save_terms([("global", None, "词", ["旧词"])]), lambda: bench.add_uploads(up)]
    with ThreadPoolExecutor(3) as pool:
        [f.result() for f in [pool.submit(a) for a in acts]]
    assert bench.store.pointer()["revision"] == 4 and contents(bench)[0].startswith("改。")
    assert bench.store.table("glossary").first().term == "词" and bench.store.table("uploads").count() == 2


def test_markdown_of_a_chapter(bench):
    assert bench.markdown(V[1], 2).startswith("## 二") and "Hello world." in bench.markdown(V[1], 2)
    for args in ((V[1], 9), ("none", 1), ("none",)):
        with pytest.raises(KeyError):
            bench.markdown(*args)
