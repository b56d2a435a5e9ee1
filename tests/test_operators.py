"""Operators on tiny tables: the known fixtures and the corner cases around them."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import alignment, batching, cleanup, edits, glossary, jobs, responder, segments, validation

CLEAN = "partition string, video_id string, sentence_id long, start_ms long, end_ms long, text string"
RAW = "partition string, video_id string, pos long, id long, start_ms long, end_ms long, raw_text string"
V = ("p", "v")


def greedy(sizes, items, most):
    out, k, n, c = [], 0, 0, 0
    for s in sizes:
        if n and (n >= items or c + s > most):
            k, n, c = k + 1, 0, 0
        out.append(k)
        n, c = n + 1, c + s
    return out


def test_batches_equal_the_rule(spark):
    rng = random.Random(1)
    rows = [[rng.randrange(0, 30) for _ in range(rng.randrange(0, 25))] for _ in range(60)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i long, s array<int>")
    for r in df.select("i", batching.batch_numbers(F.col("s"), 4, 40).alias("b")).collect():
        assert r.b == greedy(rows[r.i], 4, 40)
    df = spark.createDataFrame([("p", "v", i, "x" * 8) for i in (1, 2, 3)], "partition string, video_id string, segment_no long, joined string")
    assert [r.batch for r in segments.label_batches(df, 2, 16).orderBy("segment_no").collect()] == [0, 0, 1]


def test_circuit_breaker(spark):
    df = spark.createDataFrame([([True, False, True, True, False],), ([True, False],), ([],)], "f array<boolean>")
    assert [r.a for r in df.select(batching.circuit_open(F.col("f")).alias("a")).collect()] == [4, None, None]


def chapter(spark):
    rows = [(*V, 1, 0, 30_000, "甲。"), (*V, 2, 31_000, 90_000, "乙。"), (*V, 25, 90_000, 90_500, " "), (*V, 26, 91_000, 150_000, "Hello"), (*V, 27, 151_000, 190_000, "world.")]
    return spark.createDataFrame(rows, CLEAN)


def test_blank_sentences_and_ranges(spark):
    c = chapter(spark)
    s = segments.nonblank(c)
    assert [r.sentence_id for r in s.orderBy("sentence_id").collect()] == [1, 2, 26, 27]
    starts = spark.createDataFrame([(*V, 1), (*V, 26)], "partition string, video_id string, start_sentence_id long")
    g = segments.materialise(segments.ranges(s, starts)).orderBy("segment_no").collect()
    assert [(r.start_sentence_id, r.end_sentence_id, r.end_ms, r.content) for r in g] == [(1, 2, 90_000, "甲。乙。"), (26, 27, 190_000, "Hello world.")]
    ok = segments.materialise(segments.ranges(s, starts)).drop("joined").withColumn("manual", F.lit(False))
    assert validation.segment_faults(c, ok).count() == 0
    bad = ok.withColumn("end_ms", F.col("end_ms") + F.when(F.col("segment_no") == 2, 1).otherwise(0)).where("segment_no = 2")
    assert {(r.rule, r.pos) for r in validation.segment_faults(c, bad).collect()} == {("segments.times", 1), ("segments.no", 1), ("segments.coverage", 1), ("segments.coverage", 2)}


def test_segments_without_speech(spark):
    c = spark.createDataFrame([(*V, 1, 0, 5, " ")], CLEAN)
    none = spark.createDataFrame([], "partition string, video_id string, segment_no long, start_sentence_id long, end_sentence_id long, start_ms long, end_ms long, content string, manual boolean")
    assert validation.segment_faults(c, none).count() == 0
    assert [r.rule for r in validation.segment_faults(chapter(spark), none).where("rule = 'segments.missing'").collect()] == ["segments.missing"]


@pytest.mark.parametrize("late,faults", [(1_000, set()), (1_001, {"raw.late"})])
def test_raw_slack(spark, late, faults):
    raw = spark.createDataFrame([(*V, 1, 1, 0, 900, "a"), (*V, 2, 2, 1_000, 2_000 + late, "b")], RAW)
    head = spark.createDataFrame([(*V, 2_000, "v")], "partition string, video_id string, duration_ms long, id_in_file string")
    assert {r.rule for r in validation.raw_faults(raw, head).collect()} == faults


def test_raw_previous_end_is_the_last_rows(spark):
    raw = spark.createDataFrame([(*V, 1, 1, 0, 900, "a"), (*V, 2, 2, 100, 50, "b"), (*V, 3, 3, 60, 70, None)], RAW)
    head = spark.createDataFrame([(*V, 0, "w")], "partition string, video_id string, duration_ms long, id_in_file string")
    assert {(r.rule, r.pos) for r in validation.raw_faults(raw, head).collect()} == {("raw.times", 2), ("raw.overlap", 2), ("raw.text", 3), ("raw.video", 0)}


def test_drift_runs_stop_at_batches_and_gaps(spark):
    def loop(offsets):
        out, run = [], []
        for i, o in enumerate([*offsets, 0]):
            if run and o != offsets[run[-1]]:
                out += run if len(run) >= 3 else []
                run = []
            if o:
                run.append(i)
        return out

    rng = random.Random(5)
    rows = [[rng.choice([0, 1, 1, 1, -1]) for _ in range(20)] for _ in range(40)]
    df = spark.createDataFrame([("p", str(i), 0, j, j, o) for i, r in enumerate(rows) for j, o in enumerate(r)], "partition string, video_id string, batch long, idx long, id long, offset long")
    got = {}
    for r in cleanup.drift_runs(df).collect():
        got.setdefault(int(r.video_id), []).append(r.id)
    for i, r in enumerate(rows):
        assert sorted(got.get(i, [])) == loop(r) == responder.drifted(r)


SAID = ["the weather is fine today", "we talk about money", "lions eat meat at night", "computers count quickly", "bread needs flour and water"]


def test_neighbour_drift(spark):
    texts = [SAID[0], SAID[2], SAID[3], SAID[4], SAID[3]]
    df = spark.createDataFrame([(*V, 0, i + 1, r, t) for i, (r, t) in enumerate(zip(SAID, texts))], "partition string, video_id string, batch long, id long, raw_text string, text string")
    assert [r.id for r in cleanup.drift_runs(cleanup.drift_offsets(df)).orderBy("id").collect()] == [2, 3, 4]
    assert [responder.nearer_neighbour(SAID, i, t) for i, t in enumerate(texts)] == [0, 1, 1, 1, -1]
    assert responder.nearer_neighbour(SAID, 1, "  ") == 0


def row(i, **more):
    return {"sentence_id": i, "text": "t", "needs_review": False, "review_reason": ""} | more


@pytest.mark.parametrize("rows,good,bad", [([row(2), row(1)], {1, 2}, {}), ([row(1), row(1), row(2)], {2}, {1: "repeated"}), ([row(1)] * 3 + [row(2)], {1, 2}, {}), ([row(9), row(1)], {1}, {2: "not returned"}), ([row(1, extra=1), {"sentence_id": 2}], {1}, {2: "missing: needs_review, review_reason, text"}), ([row("1"), row(2, needs_review=1)], {1}, {2: "not a boolean"}), ([row(1, needs_review=True), row(2, review_reason="x")], set(), {1: "review without a reason", 2: "a reason without review"}), ([7, row(2)], {2}, {1: "not an object"}), ([row(None), row(2, text=5)], set(), {1: "no sentence id", 2: "not a string"})])
def test_answers(rows, good, bad):
    g, b = cleanup.judge_answers(json.dumps({"results": rows}), [1, 2])
    assert set(g) == good and b == bad


@pytest.mark.parametrize("answer", [None, "", "{}", '{"results": 1}', "[1]", "null"])
def test_answers_without_results(answer):
    assert cleanup.judge_answers(answer, [1]) == ({}, {1: "no results"})


def test_cleanup_recovers():
    ids, texts = list(range(1, 13)), [f"sentence number {w}" for w in "abcdefghijkl"]

    def broken(prompt, attempt, error):
        raise RuntimeError("down")

    found, warnings = responder.clean_video("", ids, texts, broken, [])
    assert all(found[i] == {"text": t, "needs_review": True, "review_reason": "down"} for i, t in zip(ids[:10], texts)) and len(found) == 12
    assert [w["kind"] for w in warnings] == ["batch_recovery", "range_fallback", "range_fallback", "circuit_breaker_fallback"]

    def partly(prompt, attempt, error):
        rows = json.loads(responder.echo(prompt, attempt, error))["results"]
        if len(rows) > 1:
            del rows[1]["review_reason"]
        return json.dumps({"results": rows})

    found, warnings = responder.clean_video("", ids, texts, partly, [])
    assert not warnings and [found[i]["text"] for i in ids] == texts

    def windows(prompt, attempt, error):
        """No answer for a batch; of the windows, the second fails, and the first has a row that fails alone as well."""
        rows = json.loads(responder.echo(prompt, attempt, error))["results"]
        told = [r["sentence_id"] for r in rows]
        if len(rows) > 5 or told[0] == 6:
            raise RuntimeError("busy")
        return json.dumps({"results": [{**r, "text": 1 if r["sentence_id"] == 3 else r["text"]} for r in rows]})

    found, warnings = responder.clean_video("", ids, texts, windows, [])
    assert [(w["kind"], w["sentence_ids"]) for w in warnings] == [("batch_recovery", ids), ("sentence_fallback", [3]), ("range_fallback", [6, 7, 8, 9, 10])]
    assert [i for i in ids if found[i]["needs_review"]] == [3, 6, 7, 8, 9, 10] and found[3]["review_reason"] == "not a string"


def test_retries_tell_the_error_and_wait():
    told, waits = [], []

    def respond(prompt, attempt, error):
        told.append((attempt, error))
        return "x" if attempt < 3 else "{}"

    assert responder.ask(respond, "p", responder._object, 3, waits.append) == "{}"
    assert [t[0] for t in told] == [1, 2, 3] and told[0][1] is None and told[1][1] and waits == [2.0, 4.0]


@pytest.mark.parametrize("text,want", [("甲。乙！？丙.", ["甲。", "乙！？", "丙."]), ("。。甲。” 乙。", ["。。甲。", "” 乙。"]), ("甲。？！", ["甲。？！"]), ("no end", None), ("。！", None), ("v1.5 is out. Yes!", ["v1.5 is out.", "Yes!"])])
def test_sentences(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(alignment.complete_sentences(F.col("t")).alias("s")).first().s == want


def plain_times(sentences, units, offset=0):
    """Times by walking along the units, or the error."""
    units = [(k, s, e) for t, s, e in units if (k := alignment.lexical(t))]
    if not units:
        return "no units"
    spelled, out, before, at = "".join(k for k, *_ in units), [], offset, 0
    edges = np.cumsum([0] + [len(k) for k, *_ in units]).tolist()
    for i, said in enumerate(sentences, 1):
        to = at + len(alignment.lexical(said))
        if to == at or spelled[at:to] != alignment.lexical(said) or to not in edges:
            return f"sentence {i}: units spell another text"
        start, end = offset + round(units[edges.index(at)][1] * 1000), offset + round(units[edges.index(to) - 1][2] * 1000)
        note = ["clamped"] if start < before <= start + 20 else []
        start = before if note else start
        if end == start >= before:
            end, note = end + 1, [*note, "widened"]
        if start < before or end <= start:
            return f"sentence {i}: times overlap or run backwards"
        out.append((i, said, start, end, "+".join(note)))
        before, at = end, to
    return out if at == len(spelled) else "units are left over"


def test_alignment(spark):
    cases = [(["甲。", "C."], [("甲", 0.0, 0.5), ("c", 0.485, 0.7)], 100), (["甲。"], [("甲", 0.5, 0.5)], 0), (["甲。"], [("乙", 0, 1)], 0), (["甲。"], [("甲", 0, 1), ("乙", 1, 2)], 0), (["甲。", "乙。"], [("甲", 0, 1), ("乙", 0.9, 2)], 0), (["甲。"], [], 0), (["甲。", "乙。"], [("甲乙", 0, 1)], 0), (["甲。", "。"], [("甲", 0, 1)], 0)]
    assert plain_times(*cases[0]) == [(1, "甲。", 100, 600, ""), (2, "C.", 600, 800, "clamped")] and plain_times(*cases[1])[0][2:] == (500, 501, "widened")
    rng = random.Random(3)
    for _ in range(60):
        words, clock, units = [["ab", "c", "乙"][rng.randrange(3)] for _ in range(rng.randrange(1, 12))], 0.0, []
        for w in words:
            begin = max(0.0, clock - rng.choice([0, 0, 0, 0.01, 0.02, 0.3 if rng.random() < 0.1 else 0]))
            clock = max(clock, begin + rng.choice([0, 0.0004, 0.25, 0.5005]))
            units.append((w, begin, clock))
            units += [("，", clock, clock)] * rng.randrange(2)
        cut = sorted(rng.sample(range(1, len(words) + 1), rng.randrange(1, len(words) + 1)))
        sentences = ["".join(words[a:b]) + "。" for a, b in zip([0, *cut], cut if rng.random() < 0.2 else [*cut[:-1], len(words)])]
        cases.append((sentences, units if rng.random() < 0.9 else [*units, ("x", clock, clock + 1)], rng.choice([0, 7])))
    rows = [(str(n), offset, sentences, [(t, float(a), float(b)) for t, a, b in units]) for n, (sentences, units, offset) in enumerate(cases)]
    got = alignment.timed(spark.createDataFrame([*rows, ("none", 0, None, [])], "video_id string, offset_ms long, sentences array<string>, units array<struct<text:string,start:double,end:double>>")).collect()
    for n, case in enumerate(cases):
        want = plain_times(*case)
        own = sorted((r for r in got if r.video_id == str(n)), key=lambda r: r.id or 0)
        assert ([r.error for r in own] == [want]) if isinstance(want, str) else [(r.id, r.text, r.start_ms, r.end_ms, r.note) for r in own] == want
    assert [r.error for r in got if r.video_id == "none"] == ["no complete sentences"]
    assert sum(isinstance(plain_times(*c), list) for c in cases) > 20


def test_long_sentences():
    text = "一" * 100 + "，" + "二" * 100 + "，" + "三" * 100 + "。"
    got = alignment.split_long(text, 150)
    assert alignment.lexical(got) == alignment.lexical(text) and got == "一" * 100 + "。" + "二" * 100 + "。" + "三" * 100 + "。"
    assert alignment.split_long("一" * 400 + "。") == "一" * 400 + "。"
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("一二三。") if rng.random() < 0.02 else rng.choice("一二ab ，；") for _ in range(rng.randrange(0, 900)))
        want, at = "", 0
        for stop in [m.end() for m in alignment.ENDS.finditer(text)] + [len(text)]:
            rest, at = text[at:stop], stop
            while len(alignment.lexical(rest)) > 60:  # the rule, by trying every mark of what is left
                sizes = [(i, len(alignment.lexical(rest[:i]))) for i, c in enumerate(rest) if c in "，；"]
                fit = [i for i, n in sizes if 30 <= n <= 60][-1:] or [i for i, n in sizes if 60 < n <= 90][:1]
                if not fit:
                    break
                want, rest = want + rest[: fit[0]] + "。", rest[fit[0] + 1 :]
            want += rest
        assert alignment.split_long(text, 60) == want
    with pytest.raises(ValueError):
        alignment.split_long("a", 31)


def test_pauses():
    rate = 100
    x = np.full(400 * rate, 1000, np.int16)
    x[18_200:18_210] = 0  # quiet at 182 s
    cuts = alignment.pause_cuts(x, rate)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(x) and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:]))
    assert abs(cuts[0][1] - 18_205) <= 5
    assert alignment.pause_cuts(x[:50], rate) == [(0, 50)]


def test_language(spark):
    df = spark.createDataFrame([("v", 1, "b"), ("v", 2, "a"), ("v", 3, "a"), ("v", 4, "b"), ("w", 1, " "), ("w", 2, None)], "video_id string, pos long, language string")
    assert {r.video_id: r.language for r in alignment.most_language(df).collect()} == {"v": "b", "w": "Chinese"}


def test_search_suppresses_overlaps(spark):
    def loop(text, pairs):
        taken, out = [], []
        for a, t in pairs:
            at = 0
            while (at := text.find(a, at)) >= 0:
                if all(at >= e or at + len(a) <= s for s, e in taken):
                    taken.append((at, at + len(a)))
                    out.append((a, t, at))
                    break
                at += len(a)
        return out

    rng = random.Random(9)
    pairs = glossary.replacements([("X", ["aba", "ab", "b"]), ("Y", ["ab", "ca"])])
    texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(12))) for _ in range(150)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    for r in df.select("i", glossary.spans(F.col("t"), pairs).alias("s")).collect():
        assert [(s.alias, s.term, s.at) for s in r.s] == loop(texts[r.i], pairs)


def test_search_and_apply(spark):
    c = spark.createDataFrame([(*V, "t", 1, 0, "由省管办负责，省管办"), (*V, "t", 2, 9, "省管办复核")], "partition string, video_id string, title string, sentence_id long, start_ms long, text string")
    hits = glossary.search(c, [("省管办", "审管办")])
    assert sorted(r.snippet for r in hits.collect()) == ["由省管办负责", "省管办复核"]
    one = hits.where("sentence_id = 1")
    out = {r.sentence_id: r.new_text for r in glossary.apply_hits(c, hits, one).collect()}
    assert out == {1: "由审管办负责，审管办", 2: "省管办复核"}
    changed = c.withColumn("text", F.concat("text", F.lit("。")))
    assert glossary.stale(one, glossary.search(changed, [("省管办", "审管办")])).count() == 1
    assert glossary.search(c, []).count() == 0


def test_upsert(spark):
    schema = "scope string, video_id string, term string, aliases array<string>"
    stored = spark.createDataFrame([("global", None, "t", ["a"]), ("video", "v", "u", ["x"])], schema)
    new = spark.createDataFrame([("global", None, "t", ["b", "a", " ", "t"], 1), ("video", "v", "u", ["x"], 2), ("global", None, "n", [], 3)], schema + ", ord long")
    got = {(r.scope, r.term): (r.aliases, r.changed) for r in glossary.upsert(stored, new).collect()}
    assert got == {("global", "t"): (["a", "b"], True), ("video", "u"): (["x"], False), ("global", "n"): ([], True)}


def test_chapter_save(spark):
    c = spark.createDataFrame([(*V, 1, 0, 10, "请兔南海介绍。"), (*V, 2, 10, 20, "第二句保持。")], CLEAN)
    g = spark.createDataFrame([(*V, 1, "t", "s", ["k"], 1, 2, 0, 20, "请兔南海介绍。第二句保持。", False)], "partition string, video_id string, segment_no long, title string, summary string, keywords array<string>, start_sentence_id long, end_sentence_id long, start_ms long, end_ms long, content string, manual boolean")
    e = g.select("partition", "video_id", "segment_no", F.lit("新").alias("title"), "summary", "keywords", F.lit("请通达海介绍。第二句保持。").alias("content"))
    c2, g2 = edits.save_chapter(c, g, e)
    assert [(r.text, r.start_ms) for r in c2.orderBy("sentence_id").collect()] == [("请通达海介绍。", 0), ("第二句保持。", 10)]
    r = g2.first()
    assert (r.title, r.content, r.manual) == ("新", "请通达海介绍。第二句保持。", True)
    assert validation.segment_faults(c2, g2).count() == 0


def test_job_bands(spark):
    df = spark.createDataFrame([("asr", 0.5), ("cleanup", 0.5), ("segments", 1.0), ("x", 1.0)], "s string, f double")
    assert [r.b for r in df.select(jobs.banded(F.col("s"), F.col("f")).alias("b")).collect()] == [5 + round(32.5), 72 + round(6.5), 100, None]


def test_segments_of_a_silent_video_are_only_counted(spark):
    c = spark.createDataFrame([(*V, 1, 0, 5, " ")], CLEAN)
    g = spark.createDataFrame([(*V, 7, 9, 3, 1, 2, "x", False)], "partition string, video_id string, segment_no long, start_sentence_id long, end_sentence_id long, start_ms long, end_ms long, content string, manual boolean")
    assert [r.rule for r in validation.segment_faults(c, g).collect()] == ["segments.unspoken"]
    heads = spark.createDataFrame([(*V, "w")], "partition string, video_id string, id_in_file string")
    assert {r.rule for r in validation.segment_faults(c, g, headers=heads).collect()} == {"segments.unspoken", "segments.video"}


def test_paths_lie_below_the_root(spark):
    docs = spark.createDataFrame([("p", "a", "in/a.mp4"), ("p", "b", "/in/a.mp4"), ("p", "c", "/data/in/a.mp4"), ("p", "d", None)], "partition string, video_id string, video_path string")
    files = spark.createDataFrame([("/data/in/a.mp4",)], "path string")
    assert {(r.video_id, r.rule) for r in validation.path_faults(docs, files, "/data/").collect()} == {("b", "path.missing"), ("d", "path.empty")}


def test_inputs_of_stages(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    ask = spark.createDataFrame([(i, s) for i in "abcd" for s in ("cleanup", "segments", "asr")], "id string, stage string")
    got = {(r.id, r.stage) for r in jobs.missing_inputs(ask, ids("a", "b"), ids("a", "c")).collect()}
    assert got == {("b", "segments"), ("c", "cleanup"), ("c", "segments"), ("d", "cleanup"), ("d", "segments")}


def test_run_estimates(spark):
    samples = spark.createDataFrame([("a", 0, 2000), ("a", 0, 2000), ("a", 5000, 7000), ("b", 0, 100)], "video_id string, start_ms long, end_ms long")
    runs = spark.createDataFrame([("a", 12.0, 2000, 100.0), ("b", 1.0, None, 10.0), ("c", 1.0, 5000, 10.0)], "video_id string, elapsed_seconds double, init_ms long, duration_seconds double")
    got = {r.video_id: (r.sampled_seconds, r.estimated_seconds) for r in jobs.run_estimates(samples, runs).collect()}
    assert got == {"a": (4.0, 2 + 10 * 100 / 4), "b": (0.1, 10.0), "c": (0.0, 5.0)}
