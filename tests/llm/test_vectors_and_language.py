"""Hard negatives, language mixtures and centroid clustering against brute force, and their corner cases."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from lectern.llm import centroids, hard_negatives, language
from lectern.llm.workspace import stored_bytes

VECTORS = "vec_id long, embedding array<double>, label int, dim int, mult long, side string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, t, 1, 2, "x") for i, v, t in rows], VECTORS)


def some(n, dim, seed, labels=3, spread=1.0):
    r = random.Random(seed)
    return [(i, [r.gauss(0, spread) for _ in range(dim)], r.randrange(labels)) for i in range(n)]


# --- hard negatives


def mined(rows, every, k=5, m=3):
    """Every anchor against every other row, in plain integers."""
    fine = [(i, [math.floor(256 * x) for x in v], t) for i, v, t in rows if None not in (i, v, t) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, v, t) in enumerate(fine):
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, u != t) for at2, (j, w, u) in enumerate(fine) if at2 != at and len(w) == len(v))
        for s, j, far in [x for x in scored if not x[2]][:k]:
            fits = [x for x in scored if x[2] and 50 * -s <= 100 * -x[0] <= 95 * -s][:m]
            out += [(i, j, r, x[1], -s, -x[0]) for r, x in enumerate(fits, 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("dim,blocks", [(64, (4, 16)), (7, (512, 2048)), (300, (8, 64))])
def test_negatives_equal_brute_force(spark, monkeypatch, dim, blocks):
    monkeypatch.setattr(hard_negatives, "ANCHORS", blocks[0])
    monkeypatch.setattr(hard_negatives, "ROWS", blocks[1])
    monkeypatch.setattr(hard_negatives, "STRIP", 3)
    rows = some(150, dim, dim)
    want = mined(rows, 5)
    assert want and rows_of(hard_negatives.hard_negatives(spark, vectors(spark, rows), every=5)) == want


def test_negatives_of_ties_copies_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ROWS", 8)
    r = random.Random(1)
    rows = [(i, [r.choice([0.0, 0.5, 1.0]) for _ in range(4)], r.randrange(2)) for i in range(60)]
    rows += [rows[0], rows[0], rows[7], (10, [1.0, 1.0, 0.5, 0.5], 1), (20, [1.0, 1.0, 0.5, 0.5], 0)]
    want = mined(rows, 10)
    assert want and rows_of(hard_negatives.hard_negatives(spark, vectors(spark, rows), every=10)) == want


def test_one_vector_on_most_rows(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ROWS", 16)
    rows = some(60, 8, 3) + [(100 + i, [1.0] * 8, i % 2) for i in range(90)]
    assert rows_of(hard_negatives.hard_negatives(spark, vectors(spark, rows), every=10)) == mined(rows, 10)


def test_negatives_odd(spark):
    assert hard_negatives.hard_negatives(spark, vectors(spark, [])).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert rows_of(hard_negatives.hard_negatives(spark, vectors(spark, []))) == []
    bad = [(None, [1.0, 1.0], 1), (10, None, 1), (20, [1.0, None], 1), (30, [1.0, math.nan], 1), (40, [math.inf, 1.0], 0), (50, [1.0, 1.0], None), (60, [1.0], 1), (70, [], 1), (80, [], 1), (90, [], 0)]
    rows = some(40, 2, 5, labels=2) + bad
    assert rows_of(hard_negatives.hard_negatives(spark, vectors(spark, rows), every=10)) == mined(rows, 10)
    huge = [(100, [1e200, 1.0], 1), (110, [3e7, 1.0], 0)]
    assert rows_of(hard_negatives.hard_negatives(spark, vectors(spark, rows + huge), every=10)) == mined(rows, 10)


def test_products_are_exact_beyond_doubles():
    a, b = np.array([[1 << 27, (1 << 27) + 1]], np.int32), np.array([[(1 << 27) - 1, 1 << 27], [1, -1]], np.int32)
    assert hard_negatives.product(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(a[0], w)) for w in b]]


def test_copies_of_the_grid_are_not_broadcast(spark, monkeypatch):
    plans, write = [], hard_negatives.Workspace.write
    plan_of = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(hard_negatives.Workspace, "write", lambda ws, df, *a, **o: plans.append(plan_of(df)) or write(ws, df, *a, **o))
    plans.append(plan_of(hard_negatives.hard_negatives(spark, vectors(spark, some(60, 4, 6)), every=2)))
    along = [p for p in plans if "Generate explode" in p]
    assert along and not any("BroadcastExchange" in p for p in along)


def test_scores_are_not_stored(spark, monkeypatch):
    stored, drop = [], hard_negatives.Workspace.drop_all_but
    monkeypatch.setattr(hard_negatives.Workspace, "drop_all_but", lambda ws, *kept: stored.extend(stored_bytes(t) for t in ws.tables) or drop(ws, *kept))
    assert hard_negatives.hard_negatives(spark, vectors(spark, some(2000, 8, 6)), every=2).count() > 0
    assert 0 < sum(stored) < 1 << 20  # a thousand anchors have 16 MB of scores


def test_blocks_of_bounded_bytes_and_vectors_of_several_lengths(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BYTES", 2000)
    rows = [(i + at, v, t) for dim, at in ((40, 0), (7, 100), (600, 200)) for i, v, t in some(50, dim, dim)]  # 12, 71 and one row of a block
    n, panels = collections.Counter(), hard_negatives.panels

    def counted(*a):
        out = panels(*a)
        n.update(r.dim for r in out[1].where("k = 0").select("dim").collect())
        return out

    monkeypatch.setattr(hard_negatives, "panels", counted)
    assert rows_of(hard_negatives.hard_negatives(spark, vectors(spark, rows), every=10)) == mined(rows, 10)
    assert n[7] == 1 and 2 <= n[40] <= 5 and n[600] > 20


# --- centroids


def lloyd(rows, k=8, rounds=10, dim=64):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v, _ in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    cs = [v for _, v in start[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cs))

    for _ in range(rounds):
        own = collections.defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        cs = [[sum(x) // len(own[n]) for x in zip(*own[n])] if own[n] else c for n, c in enumerate(cs)]
    got = [(i, *near(v)) for i, v in kept]
    by = collections.Counter()
    for _, d, n in got:
        by[n] += d
    return sorted(((i, n, d, by[n], sum(by.values()), hashlib.sha256(",".join(map(str, cs[n])).encode()).hexdigest()) for i, d, n in got), key=repr)


def clustered(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_lloyd_equals_brute_force(spark):
    rows = some(200, 64, 9)
    assert clustered(centroids.lloyd(spark, vectors(spark, rows))) == lloyd(rows)


def test_lloyd_of_copies_ties_and_odd_rows(spark):
    r = random.Random(2)
    rows = [(i, [float(r.randrange(-1, 2)) for _ in range(64)], 0) for i in range(40)] + [(i, [1.0] * 64, 1) for i in range(40, 80)]
    rows += [rows[0], (1, [0.25] * 64, 1), (None, [-1.0] * 64, 1), (90, None, 1), (91, [1.0] * 63, 1), (92, [1.0] * 65, 1), (93, [math.nan] * 64, 1), (94, [None] + [1.0] * 63, 1), (95, [math.inf] * 64, 1), (96, [], 1)]
    assert clustered(centroids.lloyd(spark, vectors(spark, rows))) == lloyd(rows)
    few = some(3, 64, 4)
    assert clustered(centroids.lloyd(spark, vectors(spark, few))) == lloyd(few)
    empty = centroids.lloyd(spark, vectors(spark, []))
    assert empty.collect() == [] and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    nameless = centroids.lloyd(spark, vectors(spark, [(None, [1.0] * 64, 1)])).collect()
    assert [tuple(r) for r in nameless] == [(None,) * 6]


def test_empty_centroids_stay():
    x = np.array([[0, 0], [10, 10]], np.int64)
    at, far = centroids.nearest(x, np.array([[0, 0], [0, 0], [9, 9]], np.int64))
    assert at.tolist() == [0, 2] and far.tolist() == [0, 2]


def test_lloyd_of_far_components(spark):
    rows = [(i, [(-1.0) ** i * 131_000.0] * 64, 0) for i in range(6)]
    assert clustered(centroids.lloyd(spark, vectors(spark, rows), k=2)) == lloyd(rows, k=2)
    assert centroids.lloyd(spark, vectors(spark, [(1, [1e9] * 64, 0)])).collect() == []


# --- languages

WORDS = {"aa": ["kala", "mato", "tula", "kamo", "lamu"], "bb": ["zwij", "brek", "wolf", "grij", "zolf"], "cc": ["ñoño", "éclat", "où", "ça", "naïf"]}


def text(lang, n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS[lang]) for _ in range(n))


def documents(spark, rows):
    return spark.createDataFrame([(i, t, g, "src", 1, 0.5, ["x"], "y") for i, t, g in rows], "doc_id long, text string, lang string, source string, bucket int, score double, languages array<string>, bin string")


@pytest.fixture(scope="module")
def corpus():
    return [(i, text(g, 40, i), g) for i, g in enumerate(["aa", "bb", "cc"] * 40)]


def plain_grams(t):
    c = "".join(x if x.isalpha() else " " for x in t.lower())
    c = " ".join([""] + c.split() + [""])
    return collections.Counter(c[i : i + 3] for i in range(len(c) - 2)) if c.strip() else collections.Counter()


@pytest.mark.parametrize("t", ["", "a", "Ab c", "  x1y!!ÉÀ ", "a  b\n\nc", "1 2 3", "日本 go", "é", "ß" * 9, "İx", "\ud800a"])
def test_trigrams_are_those_of_plain_text(t):
    at, n = language.trigrams(t)
    assert sorted(n.tolist()) == sorted(plain_grams(t).values()) or len(at) < len(plain_grams(t))  # bins may meet
    assert n.sum() == sum(plain_grams(t).values()) and (np.diff(at) > 0).all()
    assert bool(len(at)) == language.has_letter(t)


def test_languages_of_whole_and_mixed_texts(spark, corpus):
    mixed = [(1000, text("aa", 60, 1) + " " + text("bb", 30, 2), "zz"), (1005, text("cc", 20, 3), None), (1001, text("bb", 300, 4) + text("cc", 300, 5) + text("aa", 300, 6), None)]
    rows = [(i, t, g if g != "zz" else None) for i, t, g in mixed]
    got = {r.doc_id: r for r in language.identify(spark, documents(spark, corpus + rows)).collect()}
    assert all(got[i].lang_pred == g for i, _, g in corpus if zlib.crc32(str(i).encode()) % 5 == 0)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in corpus)
    assert got[1000].languages == ["aa", "bb"] and abs(got[1000].shares[0] - 0.66) < 0.06 and got[1000].score == got[1000].shares[0]
    assert got[1005].languages == ["cc"] and got[1005].score == 1.0
    assert sorted(got[1001].languages) == ["aa", "bb", "cc"] and all(abs(x - 1 / 3) < 0.06 for x in got[1001].shares)


def test_sets_are_those_of_a_full_search(spark, corpus):
    """Every set of languages fitted by many plain steps; the best penalised one, where it wins clearly, is the one found."""
    model = language.train(spark, documents(spark, corpus))
    for seed in range(12):
        r = random.Random(seed)
        parts = [(g, r.choice([0, 0, 5, 25])) for g in WORDS]
        t = " ".join(text(g, n, seed + 7) for g, n in parts if n) or text("aa", 10, seed)
        at, n = language.trigrams(t)
        p = np.exp(model.logs[at].astype(np.float64))

        def value(own):
            s = np.ones(len(own)) / len(own)
            for _ in range(2000):
                s = s * ((n / (p[:, own] @ s)) @ p[:, own]) / n.sum()
            return float(n @ np.log(p[:, own] @ s)) - (len(own) - 1) * language.OVERLAP * 0.5 * math.log(n.sum())

        sets = [[i for i in range(3) if b >> i & 1] for b in range(1, 8)]
        ranked = sorted(((value(s), s) for s in sets), reverse=True)
        if ranked[0][0] - ranked[1][0] > 0.1:
            assert sorted(model.infer(t)[0]) == ranked[0][1]


def test_learning_sees_no_held_out_row_and_no_more_than_its_bound(spark, corpus):
    rows = [(i, t, g) for i, t, g in corpus if zlib.crc32(str(i).encode()) % 5 == 0]
    assert language.train(spark, documents(spark, rows)).names == []
    ws = language.Workspace(spark, "test")
    picked = language.sample(ws, documents(spark, corpus), max_texts=10, languages=2).collect()
    n = collections.Counter(r.lang for r in picked)
    assert set(n) == {"aa", "bb"} or len(n) == 2 and max(n.values()) <= 10


def test_languages_odd(spark, corpus):
    odd = [(2001, None, "aa"), (2002, "", "aa"), (2003, " \n1 2 3 ...", "aa"), (2004, text("bb", 40_000, 1), None), (None, text("cc", 30, 1), "aa"), (None, None, None), (2005, "x" * 50_000, None), corpus[0], corpus[0], (0, text("cc", 50, 3), None)]
    out = language.identify(spark, documents(spark, corpus + odd)).collect()
    assert len(out) == len(corpus) + len(odd)
    got = {r.doc_id: r for r in out if r.doc_id and r.doc_id > 2000}
    assert all((got[i].lang_pred, got[i].score, got[i].languages) == ("und", 0.0, []) for i in (2001, 2002, 2003))
    assert got[2004].lang_pred == "bb" and 0 <= got[2005].score <= 1 and got[2005].lang_pred in WORDS
    assert sorted(r.lang_pred for r in out if r.doc_id is None) == ["cc", "und"]
    assert sorted(r.lang_pred for r in out if r.doc_id == 0) == ["aa", "aa", "aa", "cc"]
    empty = language.identify(spark, documents(spark, []))
    assert empty.collect() == [] and empty.columns == ["doc_id", "held_out", "lang_pred", "score", "languages", "shares"]
    assert [r.lang_pred for r in language.identify(spark, documents(spark, [(1, "abc", None)])).collect()] == ["und"]


def test_languages_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = [(r.lang_pred, r.lang) for r in language.identify(spark, docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL").collect()]
    assert len(got) > 20 and sum(a == b for a, b in got) >= 0.97 * len(got)
