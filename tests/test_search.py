"""Search for many phrases at once, against a plain loop; both ways to meet a glossary."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lectern.functions.phrases import located
from lectern.operators import glossary

ROWS = "partition string, video_id string, title string, sentence_id long, start_ms long, text string"


def loop(text, pairs):
    """The rule as stated: for each pair in order, the first occurrence of a plain text search that no span taken so far overlaps."""
    taken, out = [], []
    for alias, term in pairs:
        for m in re.finditer(re.escape(alias), text):
            if all(m.end() <= s or m.start() >= e for s, e in taken):
                taken.append(m.span())
                out.append((alias, term, m.start()))
                break
    return out


def sentences(spark, texts):
    return spark.createDataFrame([("p", f"v{i % 5}", "t", i, 0, t) for i, t in enumerate(texts)], ROWS)


def relation(spark, entries):
    return glossary.pairs_of(spark.createDataFrame([(i, t, a) for i, (t, a) in enumerate(entries)], "ord long, term string, aliases array<string>"))


def found(df):
    return sorted((r.sentence_id, r.alias, r.term, r.snippet) for r in df.collect())


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abc_中·") for _ in range(n))
    entries = [(word(3), [word(rng.randrange(1, 7)) for _ in range(rng.randrange(5))]) for _ in range(120)] + [("dup", ["aa", "aa", " aa ", "dup", "", "a b", "x" * 50]), ("dup2", ["aa"]), ("长词", ["省管办", "管办"])]
    texts = ["".join(rng.choice("abc_中· ,。\n") for _ in range(rng.randrange(60))) for _ in range(120)] + ["", "a" * 30, "aaaa", "由省管办负责，管办", "x" * 85, "q"]
    return entries, texts


def test_order_of_a_relation_is_that_of_a_list(spark, cases):
    pairs = [(r.alias, r.term) for r in relation(spark, cases[0]).orderBy("n", "ord", "at", "alias", "term").collect()]
    assert pairs == glossary.replacements(cases[0])


def test_occurrences(spark):
    df = spark.createDataFrame([("aaa",), ("",), (None,)], "t string")
    got = [[(o.alias, o.at) for o in r.o] for r in df.select(located([("aa", "x"), ("a", "y")])(F.col("t")).alias("o")).collect()]
    assert got == [[("aa", 0), ("aa", 1), ("a", 0), ("a", 1), ("a", 2)], [], []]


def test_both_ways_equal_the_loop(spark, cases):
    entries, texts = cases
    pairs = glossary.replacements(entries)
    want = [(i, a, t) for i, x in enumerate(texts) for a, t, _ in loop(x, pairs)]
    assert len(want) > 500
    listed, small, large = (found(glossary.search(sentences(spark, texts), p, **more)) for p, more in ((pairs, {}), (relation(spark, entries), {}), (relation(spark, entries), {"most_bytes": 0})))
    assert sorted(x[:3] for x in listed) == sorted(want)
    assert listed == small == large


def test_few_aliases_are_found_without_the_automaton(spark, cases):
    entries, texts = cases
    pairs = glossary.replacements([*entries[-3:], ("Q", [r"\\E", "a.c"]), ("aa", ["a", "b", "c"])])
    assert 3 < len(pairs) <= glossary.FEW
    got = found(glossary.search(sentences(spark, texts), pairs))
    assert [x[:3] for x in got] == sorted((i, a, t) for i, x in enumerate(texts) for a, t, _ in loop(x, pairs))


def test_repeated_and_null_sentences(spark):
    rows = spark.createDataFrame([("p", "v", None, 1, 0, "ab ab"), ("p", "v", None, 1, 0, "ab ab"), ("p", "v", None, 2, 0, None), ("p", "v", None, 1, 0, "other ab")], ROWS)
    one = relation(spark, [("X", ["ab"]), ("Y", None)])
    for most in (0, 100):
        assert len(found(glossary.search(rows, one, most_bytes=most))) == 3
        assert found(glossary.search(rows.limit(0), one, most_bytes=most)) == []
    assert found(glossary.search(rows, one.limit(0))) == [] and found(glossary.search(rows, [])) == []


def test_thousands_of_aliases_cost_little_more_than_a_few(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = [" ".join(word() for _ in range(60)) for _ in range(3_000)]
    many = glossary.replacements([("T", list({word() for _ in range(20_000)}))])
    df = sentences(spark, texts).persist()
    df.count()
    took = []
    for pairs in (many[:20], many):
        glossary.search(df, pairs).write.format("noop").mode("overwrite").save()
        at = time.time()
        glossary.search(df, pairs).write.format("noop").mode("overwrite").save()
        took.append(time.time() - at)
    df.unpersist()
    assert len(many) > 10_000 and took[1] < 6 * took[0] + 3
    some = {i: loop(texts[i], [p for p in many if p[0] in texts[i]]) for i in range(0, 3_000, 300)}
    got = glossary.search(sentences(spark, texts).where("sentence_id % 300 = 0"), many).collect()
    assert sorted((r.sentence_id, r.alias) for r in got) == sorted((i, a) for i, x in some.items() for a, _, _ in x)


def test_a_large_glossary_moves_few_times_the_texts(spark):
    """What is sorted or shuffled carries no row for each place of a text: only distinct words are taken apart."""
    texts = ["alpha beta gamma delta"] * 300
    df = sentences(spark, texts).unionByName(sentences(spark, ["alphabet 省管办。"]))
    made = glossary.search(df, relation(spark, [("X", ["alpha", "beta", "ph", "管办", "gammas"]), ("Y", ["alpha"])]), most_bytes=0)
    assert len(found(made)) == 300 * 2 + 2
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "Generate explode(sequence(" in line:
            assert "word" in line and "text" not in line and "video_id" not in line
    assert "Generate explode(sequence(" in plan


def test_blocks_of_a_large_glossary(spark, cases, monkeypatch):
    """However the texts are dealt, the hits are those of the loop."""
    monkeypatch.setattr(glossary, "BLOCK", 300)
    entries, texts = cases
    want = sorted((i, a, t) for i, x in enumerate(texts) for a, t, _ in loop(x, glossary.replacements(entries)))
    got = found(glossary.search(sentences(spark, texts), relation(spark, entries), most_bytes=0))
    assert [x[:3] for x in got] == want
