"""What the plans of checks and edits move and make again, and that odd rows are told as before."""

from collections import Counter

from lectern.operators import glossary, intervals, validation
from lectern.operators.segments import KEY
from lectern.plans import registry

CLEAN = "partition string, video_id string, sentence_id long, start_ms long, end_ms long, text string"
SEGMENTS = "partition string, video_id string, segment_no long, start_sentence_id long, end_sentence_id long, start_ms long, end_ms long, content string, manual boolean"


def planned(spark, df):
    """The nodes of the physical plan without broadcasts; what an exchange that is used again holds comes once."""
    held = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        todo, nodes = [df.select("*")._jdf.queryExecution().executedPlan()], []
    finally:
        for k in held:
            spark.conf.unset(k)
    while todo:
        node = todo.pop()
        nodes.append(node)
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return nodes


def exchanged(nodes):
    """(name, type) of each column of each exchange."""
    outputs = [n.output() for n in nodes if n.nodeName() == "Exchange"]
    return [(o.apply(i).name(), o.apply(i).dataType().simpleString()) for o in outputs for i in range(o.size())]


def stored(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}")
    return spark.read.parquet(f"{tmp_path}/{name}")


def test_contents_are_told_by_digests_and_texts_move_once(spark, tmp_path):
    c = stored(spark, tmp_path, "c", [("p", "v", 1, 0, 5, "a"), ("p", "v", 2, 5, 9, "b")], CLEAN)
    g = stored(spark, tmp_path, "g", [("p", "v", 1, 1, 2, 0, 9, "a b", False)], SEGMENTS)
    faults = validation.segment_faults(c, g)
    assert faults.count() == 0
    wide = [x for x in exchanged(planned(spark, faults)) if x[0] in ("content", "text", "t", "lines", "whole") and x[1] == "string"]
    assert Counter(wide) == {("t", "string"): 1}  # to find its segments; the lists that are joined are the other time


def test_a_sweep_reads_its_points_and_ranges_once(spark, tmp_path):
    p = stored(spark, tmp_path, "p", [("p", "v", i) for i in (1, 2, 70_000, 200_000)], "partition string, video_id string, at long")
    r = stored(spark, tmp_path, "r", [("p", "v", 1, 70_000), ("p", "v", 70_000, 70_000), ("p", "v", 200_000, 5)], "partition string, video_id string, a long, z long")
    told = intervals.counts(p, r, KEY, "at", "a", "z")
    assert {(x.at, x.covering) for x in told.collect()} == {(1, 1), (2, 1), (70_000, 2), (200_000, 0)}
    assert sum(n.nodeName().startswith("Scan") for n in planned(spark, told)) == 2


def test_points_with_null_keys_are_told_by_no_range(spark):
    p = spark.createDataFrame([(None, "v", 1), ("p", None, 1), ("p", "v", None), ("p", "v", 1), ("p", "v", 1)], "partition string, video_id string, at long")
    r = spark.createDataFrame([(None, "v", 0, 5), ("p", None, 0, 5), ("p", "v", 0, 5), ("p", "v", None, 5)], "partition string, video_id string, a long, z long")
    assert {(*x[:3], x.covering) for x in intervals.counts(p, r, KEY, "at", "a", "z").collect()} == {(None, "v", 1, None), ("p", None, 1, None), ("p", "v", None, 0), ("p", "v", 1, 2)}


def test_faults_of_odd_rows(spark):
    """Null keys, repeated sentences and segments, null borders and contents, silent videos."""
    c = [(None, "n", 1, 0, 5, "a"), ("p", "twice", 1, 0, 5, "a"), ("p", "twice", 1, 1, 5, "b"), ("p", "copy", 1, 0, 5, "a"), ("p", "null", 1, 0, 5, None), ("p", "null", 2, 5, 9, "b"), ("p", "mute", 1, 0, 5, " "), ("p", "lone", 1, 0, 5, "a")]
    g = [(None, "n", 1, 1, 1, 0, 5, "a", False), ("p", "twice", 1, 1, 1, 0, 5, "a b", False), *[("p", "copy", 1, 1, 1, 0, 5, "a", False)] * 2, ("p", "null", 1, 1, 2, 0, 9, None, True), ("p", "null", 2, None, 2, 0, 9, "b", False), ("p", "mute", 4, 1, 1, 0, 1, "x", False), ("p", "far", 1, 1, 1, 0, 1, "x", False)]
    got = Counter((r.video_id, r.rule, r.pos) for r in validation.segment_faults(spark.createDataFrame(c, CLEAN), spark.createDataFrame(g, SEGMENTS)).collect())
    assert got == {("copy", "segments.content", 1): 1, ("copy", "segments.coverage", 1): 1, ("copy", "segments.no", 2): 1, ("copy", "segments.order", 2): 1, ("far", "segments.anchor", 1): 1, ("lone", "segments.coverage", 1): 1, ("lone", "segments.missing", 0): 1, ("mute", "segments.unspoken", 0): 1, ("n", "segments.anchor", 1): 1, ("n", "segments.missing", 0): 1, ("null", "segments.anchor", 2): 1, ("null", "segments.content", 1): 1, ("twice", "segments.coverage", 1): 1, ("twice", "segments.times", 1): 2}


def test_counts_of_replacements_run_nothing_before_they_are_read(spark):
    """Hits of null keys and repeated hit ids count as before; null ids count as none."""
    c = spark.createDataFrame([("p", "v", 1, "ab"), ("p", "v", 1, "ab c"), ("p", "w", 1, "zz"), (None, "v", 1, "ab"), ("p", "v", 2, None)], "partition string, video_id string, sentence_id long, text string")
    hits = spark.createDataFrame([("p", "v", 1, "h", "ab", "x"), ("p", "v", 1, "h", "ab", "x"), (None, "v", 1, "n", "ab", "x"), ("p", "w", 1, None, "z", "x"), ("p", "v", 2, "m", "a", "x")], "partition string, video_id string, sentence_id long, hit_id string, alias string, term string")
    chosen = spark.createDataFrame([("h",), ("h",), ("n",), ("m",), (None,)], "hit_id string")
    edited = glossary.apply_hits(c, hits, chosen)
    assert Counter((r.partition, r.video_id, r.sentence_id, r.new_text) for r in edited.collect()) == {("p", "v", 1, "x"): 1, ("p", "v", 1, "x c"): 1, ("p", "w", 1, "zz"): 1, (None, "v", 1, "ab"): 1, ("p", "v", 2, ""): 1}
    spark.sparkContext.setJobGroup("counts", "counts")
    try:
        told = glossary.applied_counts(edited, chosen)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("counts")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert told.dtypes == [("selected", "bigint"), ("changed_sentences", "bigint"), ("changed_videos", "bigint")]
    assert [tuple(r) for r in told.collect()] == [(3, 3, 1)]
    none = glossary.applied_counts(edited.limit(0), chosen.limit(0))
    assert [tuple(r) for r in none.collect()] == [(0, 0, 0)]


def test_the_flagship_decides_its_sentences_eight_times(spark):
    """Once each for its output, its folds, its coverage's points and ranges, its speech, its anchors, its contents and what they are built from."""
    nodes = planned(spark, registry.flagship(spark, "/root/testdata/sf0.001"))
    columns = [{n.output().apply(i).name() for i in range(n.output().size())} for n in nodes if n.nodeName() == "SortMergeJoin"]
    assert sum("proposed" in c for c in columns) <= 8
