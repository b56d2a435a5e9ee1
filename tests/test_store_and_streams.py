"""Readers, the versioned store, and the progress stream."""

import collections
import hashlib
import io
import json
import time
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import alignment, jobs
from lectern.sources import documents, files
from lectern.sources import store
from lectern.sources.store import ConflictError, Store, quarantine
from lectern.streaming import progress

ID = "ab" * 32


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_documents(spark, tmp_path):
    doc = {"id": ID, "title": "题", "duration_ms": 5, "sentences": [{"id": 1, "start_ms": 0, "end_ms": 2, "raw_text": "a"}, {"id": 2, "start_ms": 2, "end_ms": 5, "raw_text": "b\nc"}]}
    put(tmp_path / "asr_raw/2026-09" / f"{ID}.json", json.dumps(doc, indent=2, ensure_ascii=False))
    put(tmp_path / "asr_raw/2026-09/manifest.json", "{}")
    put(tmp_path / "asr_raw/2026-10" / f"{'cd' * 32}.json", "[not json")
    d = documents.documents(spark, str(tmp_path), "asr_raw")
    got = {r.file_id[:2]: r for r in d.collect()}
    assert set(got) == {"ab", "cd"} and got["ab"].title == "题" and got["ab"].partition == "2026-09"
    assert got["cd"].id is None and got["cd"]._corrupt_record
    rows = documents.children(d, "asr_raw").orderBy("pos").collect()
    assert [(r.pos, r.id, r.raw_text) for r in rows] == [(1, 1, "a"), (2, 2, "b\nc")]
    again = documents.nested(documents.children(d, "asr_raw"), "pos", "sentences").first().sentences
    assert [s.raw_text for s in again] == ["a", "b\nc"]
    with pytest.raises(FileNotFoundError):
        documents.selected(d, "no such id")
    assert documents.selected(d, limit=1).count() == 1 and documents.selected(d, limit=-3).count() == 0


def test_uploads_and_glossary(spark, tmp_path):
    put(tmp_path / "up/a/x.MP4", "same")
    put(tmp_path / "up/b/x.MP4", "same")
    put(tmp_path / "up/b/y.txt", "other")
    assert documents.uploads(spark, str(tmp_path / "up")).count() == 2
    assert [r.path.rsplit("/", 1)[1] for r in documents.video_files(spark, str(tmp_path / "up")).collect()] == ["x.MP4", "x.MP4"]
    put(tmp_path / "g.json", json.dumps({"global": {"t": ["a"]}, "sources": {ID: {"u": ["b", "c"]}}}))
    got = {(r.scope, r.video_id, r.term): r.aliases for r in documents.glossary(spark, str(tmp_path / "g.json")).collect()}
    assert got == {("global", None, "t"): ["a"], ("video", ID, "u"): ["b", "c"]}
    assert documents.glossary(spark, str(tmp_path / "none.json")).count() == 0


def rows(spark, n):
    return spark.createDataFrame([(f"p{i % 2}", f"v{i}", i) for i in range(n)], "partition string, video_id string, x long")


def test_commits_are_whole_and_checked(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"), ("a", "b", "c"))
    with pytest.raises(FileNotFoundError):
        s.table("a")
    assert s.commit({"a": rows(spark, 4), "b": rows(spark, 2)}, 0) == 1
    old = s.pointer()
    assert s.commit({"a": rows(spark, 6)}, 1) == 2
    assert (s.table("a").count(), s.table("b").count(), s.table("a", old).count()) == (6, 2, 4)
    with pytest.raises(ConflictError):
        s.commit({"b": rows(spark, 1)}, 1)
    bad = rows(spark, 3).withColumn("x", F.raise_error(F.lit("boom")))
    with pytest.raises(Exception, match="boom"):
        s.commit({"b": rows(spark, 1), "c": bad}, 2)
    assert s.pointer()["revision"] == 2 and s.table("b").count() == 2
    assert s.delete_video("v1", 2) == (3, 2) and s.table("a").count() == 5
    assert s.vacuum() >= 2 and s.table("a").count() == 5


def test_two_writers(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"), ("a", "b", "c"))
    assert s._put(f"{s.root}/_commits/000000000001.json", "{}") and not s._put(f"{s.root}/_commits/000000000001.json", "{}")


def test_quarantine(spark):
    good, bad = quarantine(spark.createDataFrame([(1, None), (2, "e")], "i long, error string"))
    assert [r.i for r in good.collect()] == [1] and [r.i for r in bad.collect()] == [2]


def event(stage, done):
    return f'{jobs.PREFIX}{{"stage":"{stage}","completed":{done},"total":10,"detail":"d{done}"}}'


def test_progress_stream_never_falls(spark, tmp_path):
    feed, n = tmp_path / "feed", 0
    batches = [[event("asr", 5), "plain log"], [event("asr", 2), event("cleanup", 10)], [event("asr", 10)]]
    for k, lines in enumerate(batches):
        put(feed / f"{k}.json", "\n".join(json.dumps({"job_id": "j", "item": "v", "expected_stage": "asr", "seq": (n := n + 1), "line": x}) for x in lines))
    q = progress.snapshots(progress.line_stream(spark, str(feed)).repartition(1)).writeStream.outputMode("update").format("memory").queryName("snap").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("snap").collect()
    last = max(got, key=lambda r: (r.progress, len(r.log)))
    assert last.progress == 70 and last.detail == "d10" and "plain log" in last.log and event("cleanup", 10) in last.log
    assert [r.progress for r in got] == sorted(r.progress for r in got)


def test_state_of_silent_items_ends(spark, tmp_path):
    """Late and repeated lines change nothing, a restart goes on from the checkpoint, and silent items leave no state."""
    feed, cp = tmp_path / "feed", str(tmp_path / "cp")
    line = lambda item, seq, text: json.dumps({"job_id": "j", "item": item, "expected_stage": "asr", "seq": seq, "line": text})
    seen = {}

    def run(k, *lines, until):
        put(feed / f"{k}.json", "\n".join(lines))
        keep = lambda df, i: seen.update({r.item: (r.progress, r.log) for r in df.collect()})
        q = progress.snapshots(progress.line_stream(spark, str(feed)), idle_ms=2_000).writeStream.outputMode("update").trigger(processingTime="200 milliseconds").foreachBatch(keep).option("checkpointLocation", cp).start()
        end, held = time.time() + 60, lambda: [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]][-1:]
        while not until(held()) and time.time() < end:
            time.sleep(0.2)
        fine = until(held())
        q.stop()
        return fine

    assert run(0, line("a", 2, event("asr", 5)), line("a", 1, "first"), line("b", 1, event("asr", 10)), line("a", 2, event("asr", 5)), until=lambda n: len(seen) == 2)
    assert seen == {"a": (37, "first\n"), "b": (70, "")}
    assert run(1, line("a", 1, "first"), line("a", 3, "second"), line("c", 1, "x"), until=lambda n: "c" in seen and "second" in seen["a"][1])
    assert seen["a"][1].endswith("second\n") and seen["b"] == (70, "")
    assert run(2, line("d", 1, event("asr", 10)), until=lambda n: "d" in seen and n == [0])


def test_fingerprints_follow_the_tree(spark):
    clips = spark.createDataFrame([("v", i, f"c{i}") for i in range(4)] + [("v", 4, None)], "video_id string, no long, content string")
    stages = {"asr": {"model": "a", "words": ["x"]}, "align": {"model": "b"}}
    made = lambda c=clips, r={"cut": 180}, s=stages: {x.no: (x.asr, x.align) for x in alignment.fingerprinted(c, r, s).collect()}  # noqa: E731, B006
    base = made()
    assert len({f for x in base.values() for f in x if f}) == 8 and base[4] == (None, None)
    assert made(s={"asr": {"words": ["x"], "model": "a"}, "align": {"model": "b"}}) == base
    later, earlier, cut = made(s=stages | {"align": {"model": "c"}}), made(s=stages | {"asr": {"model": "z"}}), made(r={"cut": 60})
    assert all(later[i][0] == base[i][0] and later[i][1] != base[i][1] for i in range(4))
    assert all(x[i][k] != base[i][k] for x in (earlier, cut) for i in range(4) for k in (0, 1))
    one = made(clips.withColumn("content", F.when(F.col("no") == 2, "other").otherwise(F.col("content"))))
    assert [i for i in range(4) if one[i] != base[i]] == [2]
    stored = alignment.fingerprinted(clips, {"cut": 180}, stages).where("no < 2").select(F.col("asr").alias("fingerprint"), F.lit("t").alias("raw_transcription"), F.lit("l").alias("language"))
    again = alignment.resumable(alignment.fingerprinted(clips, {"cut": 180}, stages).withColumnRenamed("asr", "fingerprint"), stored)
    assert {r.no: r.raw_transcription for r in again.collect()} == {0: "t", 1: "t", 2: None, 3: None, 4: None}


def test_published_snapshots(spark, tmp_path):
    put(tmp_path / "feed/0.json", json.dumps({"job_id": "j", "item": "v", "expected_stage": "asr", "seq": 1, "line": event("asr", 5)}))
    seen = []
    q = progress.publish(progress.item_progress(progress.line_stream(spark, str(tmp_path / "feed"))), lambda df, i: seen.extend(r.progress for r in df.collect()), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert seen == [5 + 32]


def test_recordings(spark, tmp_path):
    def wav(channels):
        b = io.BytesIO()
        with wave.open(b, "wb") as w:
            w.setnchannels(channels)
            w.setsampwidth(2)
            w.setframerate(1000)
            w.writeframes(np.zeros(1000 * 200 * channels, "<i2").tobytes())
        return b.getvalue()

    df = spark.createDataFrame([("a.wav", wav(1))], "path string, content binary")
    r = alignment.audio_ranges(df).orderBy("no").collect()
    assert r[0].start == 0 and r[-1].stop == 200_000 and len(r) == 2
    with pytest.raises(ValueError):
        alignment.wav_samples(wav(2))


def test_files_of_any_size(spark, tmp_path):
    """A recording of 3 GB, more than a row can hold: its hash, and its ranges with the first pause where silence was put into noise."""
    rate, total = 16_000, 1_500_000_000
    path = tmp_path / "a dir/long 1%.wav"
    path.parent.mkdir()
    with open(path, "wb") as f:
        f.write(b"RIFF" + (36 + 2 * total).to_bytes(4, "little") + b"WAVEfmt " + (16).to_bytes(4, "little") + b"".join(n.to_bytes(k, "little") for n, k in ((1, 2), (1, 2), (rate, 4), (2 * rate, 4), (2, 2), (16, 2))) + b"data" + (2 * total).to_bytes(4, "little"))
        noise = np.random.RandomState(0).randint(1, 9000, 12 * rate).astype("<i2")
        noise[7 * rate : 8 * rate] = 0
        f.seek(44 + 2 * 174 * rate)
        f.write(noise.tobytes())
        f.truncate(44 + 2 * total)  # the rest is a hole
    listed = files.listed(spark, str(tmp_path))
    got = alignment.audio_ranges(listed).orderBy("no").collect()
    assert got[0].start == 0 and got[-1].stop == total and all(a.stop == b.start for a, b in zip(got, got[1:]))
    assert 181 * rate < got[0].stop < 182 * rate and got[1].stop - got[1].start == (180 - 5) * rate + rate // 20
    with open(path, "rb") as f:
        want = hashlib.file_digest(f, "sha256").hexdigest()
    assert [(r.id, r.size) for r in documents.uploads(spark, str(tmp_path)).collect()] == [(want, path.stat().st_size)]


def test_ranges_by_windows_equal_those_of_samples_at_hand(spark, tmp_path):
    for seed in range(3):
        rng = np.random.RandomState(seed)
        x = (rng.randn(1000 * (150 + 200 * seed)) * 3000 * np.abs(np.sin(np.arange(1000 * (150 + 200 * seed)) / 777))).astype("<i2")
        with wave.open(str(tmp_path / f"{seed}.wav"), "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(1000)
            w.writeframes(x.tobytes())
    broken = (tmp_path / "2.wav").read_bytes()[:-201]
    (tmp_path / "3.wav").write_bytes(broken)
    (tmp_path / "4.wav").write_bytes((tmp_path / "2.wav").read_bytes()[:44])  # a header alone
    got = collections.defaultdict(list)
    for r in alignment.audio_ranges(files.listed(spark, str(tmp_path))).orderBy("no").collect():
        got[int(r.path[-5])].append((r.start, r.stop))
    for i in range(4):
        rate, samples = alignment.wav_samples((tmp_path / f"{i}.wav").read_bytes())
        assert rate == 1000 and got[i] == alignment.pause_cuts(samples, rate)
    assert 4 not in got and got[3][-1][1] == got[2][-1][1] - 101
    assert files.digests(spark.createDataFrame([(None,)], "path string")).first().id is None
    with pytest.raises(Exception, match="FileNotFoundError"):
        files.digests(spark.createDataFrame([(str(tmp_path / "gone"),)], "path string")).collect()


def test_config(tmp_path):
    from lectern.sources.config import load_config

    put(tmp_path / "conf/c.json", '{"data_root": "d"}')
    c = load_config(tmp_path / "conf/c.json")
    assert c.path("x") == str(tmp_path / "conf/x") and c.path("s3://b/x") == "s3://b/x"
    assert load_config(tmp_path / "conf/c.json", tmp_path).stage_root("asr_raw", "2026-09") == str(tmp_path / "d/asr_raw/2026-09")
    put(tmp_path / "l.json", "[]")
    with pytest.raises(ValueError):
        load_config(tmp_path / "l.json")


def test_markdown_files_hold_the_document(spark, tmp_path):
    docs = [("0", "v1", "# x\n\ntext\n"), ("0", "v2", "# y"), ("1", "v3", "a\n\n")]
    store.write_markdown(spark.createDataFrame(docs, "partition string, video_id string, markdown string"), f"file://{tmp_path}/md")
    for part, video, text in docs:
        found = [p.read_bytes() for p in (tmp_path / "md" / f"partition={part}" / f"video_id={video}").glob("part-*")]
        assert found == [(text if text.endswith("\n") else text + "\n").encode()]
