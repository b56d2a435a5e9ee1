"""The corpus operators: brute force, round trips, held-out accuracy, and the corner cases every operator must stand."""

import collections
import glob
import hashlib
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import line_dedup, media, mixing, ngram_join, packing, quality, queries, revisits, toxicity, url_filter
from lectern.llm.components import connected_components
from lectern.llm.ngram_join import near_duplicates
from lectern.llm import range_join as range_join_module
from lectern.llm.range_join import range_join
from lectern.llm.workspace import Workspace

D = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, root long, size string, hub long"
tables = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
LONG = "wort " * 40_000 + "x" * 50_000


def table(spark, name):
    return spark.read.parquet(f"{D}/{name}.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids, clashing names."""
    texts = [None, "", " \n\t", "a", "a b", LONG, "same text of five words", "same text of five words", "é 1\n\n2 ü", "<|endoftext|> x", "ß" * 5_000]
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else "src", None, 1.0, 2, "s", 3) for i, t in enumerate(texts)]
    rows += [rows[6], (None, "no id", None, None, 1, None, None, None, None), (None, None, None, None, None, None, None, None, None), (6, "another text under the same id", "de", "x", 2, 1.0, 1, "t", 1)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, None), (None, 1, 1), (3, None, 1), (6, 1, 0), (6, 0, 1), (8, 7, 0)], "doc_id long, quality int, toxic int")


# --- near duplicates


def components(sets, num, den):
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def shingles(text, n):
    w = (text or "").encode().lower().split()
    k = min(n, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def close_texts(seed, n):
    """Groups of texts with few edits, chains of them, and texts that share long passages."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    shared = rng.choices(words, k=40)
    out = []
    while len(out) < n:
        base = rng.choices(words, k=rng.choice([3, 9, 20, 60, 150]))
        if rng.random() < 0.4:
            base += shared
        for _ in range(rng.randrange(1, 7)):
            for _ in range(rng.randrange(0, 3)):
                base = list(base)
                i = rng.randrange(len(base))
                if rng.random() < 0.5:
                    base[i] = rng.choice(words)
                else:
                    base.insert(i, rng.choice(words))
            out.append(" ".join(base))
    return out[:n]


@pytest.mark.parametrize("n,num,den", [(3, 9, 10), (5, 4, 5), (1, 1, 2)])
def test_near_duplicates_equal_brute_force(spark, n, num, den):
    texts = dict(enumerate(close_texts(n, 220)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark, spark.createDataFrame(list(texts.items()), "doc_id long, text string"), n, num, den).collect()}
    sets = {i: shingles(t, n) for i, t in texts.items()}
    want = components(sets, num, den)
    assert got == {i: (len(sets[i]), want[i]) for i in texts}


@pytest.mark.parametrize("n,num,den", [(3, 9, 10), (5, 4, 5), (1, 1, 2)])
def test_linked_sets_share_an_entry(n, num, den):
    """Whatever the allocation: a set and its linked neighbours index an entry in common."""
    rng = np.random.RandomState(n)
    bands = ngram_join.Bands(num, den)
    linked = 0
    for _ in range(1500):
        size = int(np.exp(rng.uniform(0.5, 6)))
        x = np.unique(rng.randint(0, 2**63, size, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1))
        y = np.unique(np.concatenate([x[rng.rand(len(x)) > rng.uniform(0, 1 - num / den)], rng.randint(0, 2**63, rng.randint(0, 2 + size // 8), np.int64).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        if den * both >= num * (len(x) + len(y) - both) and len(y) and (x.tobytes() != y.tobytes()):
            linked += 1
            for long in (frozenset(), frozenset(range(64))):
                assert np.intersect1d(ngram_join.signatures(x, bands, long), ngram_join.signatures(y, bands, long)).size
    assert linked > 200


def test_links_of_all_texts_of_an_id(spark):
    rng = random.Random(5)
    a, b = (" ".join(rng.choices([f"w{i}" for i in range(900)], k=60)) for _ in "ab")
    docs = spark.createDataFrame([(6, a), (6, b), (7, b + " more"), (8, a + " word"), (9, "own text")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(spark, docs, 3, 9, 10).collect()}
    assert got == {6: 6, 7: 6, 8: 6, 9: 9}


def test_long_segments_are_exact(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "long_bands", lambda *a: frozenset(range(64)))
    texts = dict(enumerate(close_texts(11, 220)))
    got = {r.doc_id: r.component_id for r in near_duplicates(spark, spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 5, 4, 5).collect()}
    assert got == components({i: shingles(t, 5) for i, t in texts.items()}, 4, 5)


def test_allocation_weighs_counted_costs(spark):
    """Short segments whose buckets are crowded make a band's segments long; otherwise their fewer rows win."""
    kinds = lambda n: [(c, (s << 7) | 2 * 5) for c in range(n) for s in range(3)] + [(c, ((100 + 9 * c + s) << 7) | 2 * 5 + 1) for c in range(n) for s in range(9)]
    crowded, apart = kinds(400), [(c, ((c << 10 | i) << 7) | 2 * 5 + k) for c in range(400) for k in (0, 1) for i in range(3 if not k else 9)]
    make = lambda rows: spark.createDataFrame(rows, "cls long, sample long")
    assert ngram_join.long_bands(make(crowded), 4, 5) == {5} and ngram_join.long_bands(make(apart), 4, 5) == set()


def test_one_large_group_of_near_copies(spark):
    """Half the copies are too far from the group's smallest id, so that blocks decide them."""
    rng = random.Random(2)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    texts = []
    for _ in range(150):
        t = list(base)
        for _ in range(rng.randrange(0, 5)):
            t[rng.randrange(len(t))] = f"n{rng.randrange(10_000)}"
        texts.append(" ".join(t))
    got = {r.doc_id: r.component_id for r in near_duplicates(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3, 9, 10).collect()}
    assert got == components({i: shingles(t, 3) for i, t in enumerate(texts)}, 9, 10)


def test_near_duplicates_odd(spark, odd, none):
    got = collections.defaultdict(list)
    for r in near_duplicates(spark, odd, 3, 9, 10).collect():
        got[r.doc_id].append((r.n_shingles, r.component_id))
    assert got[0] == got[1] == got[2] == [(0, got[0][0][1])] or [got[i][0] for i in (0, 1, 2)] == [(0, 0), (0, 1), (0, 2)]
    assert sorted(got[6]) == [(3, 6), (3, 6), (4, 6)] and got[7] == [(3, 6)]
    assert sorted(got[None], key=str) == sorted([(0, None), (1, None)], key=str)
    assert near_duplicates(spark, none).collect() == []


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(None, 1), (5, 5)]
    adj = collections.defaultdict(set)
    for a, b in edges:
        if a is not None and a != b:
            adj[a].add(b)
            adj[b].add(a)
    root = {}
    for s in sorted(adj):
        todo = [s] if s not in root else []
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = s
                todo += adj[x]
    got = connected_components(Workspace(spark, "t"), spark.createDataFrame(edges, "a long, b long"), "a", "b")
    assert {r.node: r.root for r in got.collect()} == root
    assert connected_components(Workspace(spark, "t"), spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


# --- embeddings


def test_range_join_equals_brute_force(spark):
    rng = np.random.RandomState(1)
    rows = []
    for i in range(400):
        v = rng.normal(size=8)
        for _ in range(rng.randint(1, 4)):
            rows.append((len(rows), (v + rng.normal(scale=0.08, size=8)).astype(np.float32).tolist(), int(i % 3)))
    rows += [(len(rows) + i, rows[0][1], 0) for i in range(30)]
    rows += [(5000, None, 0), (5001, [0.0] * 8, 0), (5002, [float("nan")] * 8, 0), (5003, rows[0][1], None), (5004, [float("inf")] + [0.0] * 7, 0), (5005, [], 0), (5006, rows[0][1][:7], 0), (None, rows[0][1], 0), (5007, [None] * 8, 1)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in range_join(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    fine = [r for r in rows if r[0] is not None and r[0] < 5000]
    x = np.array([r[1] for r in fine], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lab = np.array([r[2] for r in fine])
    near = (x @ x.T >= 0.98) & (lab[:, None] == lab)
    np.fill_diagonal(near, False)
    root = np.arange(len(fine))
    while True:
        new = np.minimum(root, np.where(near, root, 10**9).min(1))
        if (new == root).all():
            break
        root = new
    for i in range(len(fine)):
        assert got[i] == (near[i].sum(), root[i], root[i] == i)
    assert all(got[i] == (0, i, True) for i in range(5000, 5008))
    assert got[None] == (0, None, None)
    assert range_join(spark, spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_range_join_of_extreme_lengths(spark):
    """Squares that over- or underflow, subnormal numbers, and vectors alike but for their length."""
    rows = [(1, [1e200, 0.0], 0), (2, [1e200, 0.0], 0), (3, [1e-170, 0.0], 0), (4, [1.0, 0.0], 0), (5, [5e-324, 0.0], 0), (6, [0.0, 1.7e308], 0), (7, [0.0, 1.0], 1), (8, [-1e300, 0.0], 0)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in range_join(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {**{i: (4, 1, i == 1) for i in range(1, 6)}, **{i: (0, i, True) for i in (6, 7, 8)}}


def test_range_join_of_repeated_ids(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (3, [0.01, 1.0], 0), (2, [1.0, 0.01], 0)]
    got = sorted(map(tuple, range_join(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()))
    assert got == [(1, 1, 1, True), (1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (3, 1, 1, False)]


def test_tasks_of_many_pivots_stay_small():
    from pyspark import cloudpickle

    p = np.random.RandomState(1).normal(size=(4_000, 64))
    assert len(cloudpickle.dumps(range_join_module._cells({("a", 64): p}, 0.2))) < 10e6


def test_range_join_of_large_labels(spark, monkeypatch):
    """Many pivots and several blocks a cell, labels beyond those with pivots, repeated rows and other columns."""
    monkeypatch.setattr(module := range_join_module, "_block", lambda dim: 16)
    monkeypatch.setattr(module, "BLOCK_NUMBERS", 64 * 6)
    monkeypatch.setattr(module, "PIVOT_NUMBERS", 485)  # the third label gets none
    rng = np.random.RandomState(7)
    base = rng.normal(size=(60, 6))
    x = np.concatenate([b + rng.normal(scale=0.05, size=(rng.randint(1, 25), 6)) for b in base])
    lab = rng.choice(3, len(x), p=[0.7, 0.2, 0.1])
    rows = [(i, v.tolist(), int(k), 1, "c") for i, (v, k) in enumerate(zip(x, lab))]
    got = {r.vec_id: (r.n_links, r.component_id) for r in range_join(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, rep int, cell string")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.98) & (lab[:, None] == lab)
    np.fill_diagonal(near, False)
    root = np.arange(len(x))
    while not (new := np.minimum(root, np.where(near, root, 10**9).min(1))).tolist() == root.tolist():
        root = new
    assert got == {i: (int(near[i].sum()), int(root[i])) for i in range(len(x))}


# --- packing and media


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def check_pieces(pieces, texts, path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    ids = {i: np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4") for i, x in texts.items()}
    docs, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert len(part) == p.length > 0 and zlib.crc32(part.tobytes()) == p.ids_crc32 and p.doc_tokens == len(ids[p.doc_id])
        docs[p.doc_id].append((p.start, p.length))
        seqs[p.sequence_id].append((p.offset, p.length))
    for spans, whole in [(docs[i], len(ids[i])) for i in ids] + [(s, None) for s in seqs.values()]:
        at = 0
        for a, n in sorted(spans):
            assert a == at
            at += n
        assert at == whole if whole is not None else at <= 2048
    sizes = [sum(n for _, n in s) for s in seqs.values()]
    assert sum(2048 - n for n in sizes if n & (n - 1)) <= 0.01 * sum(sizes)


@tables
def test_packing_round_trip(spark, tokenizer):
    docs = table(spark, "documents")
    check_pieces(packing.pack(spark, docs, *tokenizer).collect(), {r.doc_id: r.text for r in docs.collect()}, tokenizer[0])


def test_packing_odd(spark, odd, none, tokenizer):
    docs = odd.dropDuplicates(["doc_id"]).where("doc_id IS NOT NULL")
    texts = {r.doc_id: r.text for r in docs.collect()}
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, curve int")
    check_pieces(packing.pack(spark, docs, *tokenizer).collect(), texts, tokenizer[0])
    check_pieces(packing.pack(spark, docs, tokenizer[0]).collect(), texts, tokenizer[0])
    assert packing.pack(spark, odd, *tokenizer).where("doc_id IS NULL").count() == 2
    assert packing.pack(spark, none, *tokenizer).collect() == []


def test_hilbert_neighbours_are_close():
    packing_bits, packing.BITS = packing.BITS, 3
    try:
        grid = np.stack(np.meshgrid(*[np.arange(8)] * 2, indexing="ij"), -1).reshape(-1, 2)
        order = grid[np.argsort(packing.hilbert_keys(grid))]
        assert sorted(packing.hilbert_keys(grid)) == list(range(64)) and (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()
    finally:
        packing.BITS = packing_bits


def test_media_round_trip(spark, odd, none):
    texts = odd.select("doc_id", "text").collect()
    got = media.media_columns(spark, odd).collect()
    assert len(got) == len(texts)
    by = collections.defaultdict(set)
    for r in texts:
        b = (r.text or "").encode()
        p = b + b"\xff" * ((-len(b)) % 576 if b else 576)
        by[r.doc_id].add((len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    for g in got:
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) in by[g.doc_id]
        assert g.width * g.height == g.payload_bytes
    assert len({(g.media_sha256, g.feature, g.media_bytes) for g in got if g.doc_id in (6, 7) and g.n_bytes == 23}) == 1
    assert media.media_columns(spark, none).collect() == []
    for n in (0, 1, 575, 576, 577, 5000):
        p = media.payload_of(os.urandom(n))
        assert media.from_image(media.to_image(p)) == p and len(p) % 576 == 0 and len(p) >= max(576, n)


# --- lines, mixing, urls, revisits


def test_lines(spark, none):
    long = "the quick brown fox jumps over it"
    rows = [(i, f"{chr(97 + i) * 3} own words {chr(98 + i) * 2} alone\n{long}\nUser {i} logged in from host {i} today\nshort") for i in range(8)]
    out = {r.doc_id: r for r in line_dedup.dedup_lines(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0].text == rows[0][1] and out[0]._dropped == 0
    for i in range(1, 8):
        assert out[i].text == rows[i][1].split("\n")[0] and (out[i]._lines, out[i]._dropped) == (4, 3)
    few = line_dedup.dedup_lines(spark, spark.createDataFrame(rows[:4], "doc_id long, text string"))
    assert few.where("_dropped > 0").count() == 0
    assert line_dedup.dedup_lines(spark, none).collect() == []


def test_lines_with_variable_words(spark):
    """Values of a field that stand in many lines of the leaf are no constants of its template."""
    name = lambda i: chr(97 + i) * 3
    rows = [(20 * i + j, f"{name(i)}{name(j)}\nLogged in user {name(i)} from city {name(j).upper()}") for i in range(20) for j in range(20)]
    out = {r.doc_id: r for r in line_dedup.dedup_lines(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0].text == rows[0][1] and out[0]._dropped == 0
    assert all(out[i].text == rows[i][1].split("\n")[0] and out[i]._dropped == 1 for i in range(1, 400))


def test_lines_of_digits_go_as_a_whole(spark):
    own = lambda i: f"Row {i} 1{i} 2{i} 3{i}"
    rows = [(i, f"Copyright 2021 Acme Corp\n{own(i)}\nPage 3  of 10\n555-0100 555-0101 555-0102 555-0103") for i in range(6)]
    out = {r.doc_id: r for r in line_dedup.dedup_lines(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0].text == rows[0][1]
    assert all((out[i].text, out[i]._dropped) == (own(i), 3) for i in range(1, 6))


def test_short_lines_go_as_a_whole(spark):
    """But for blanks; a line of five documents goes, one of four stays; layout stays."""
    rows = [(i, f"All  rights reserved.\nown{chr(97 + i)}\n  \n}}\nPage {i % 2}\n---\n{'four times' if i < 4 else 'less'}") for i in range(6)]
    out = {r.doc_id: r for r in line_dedup.dedup_lines(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0].text == rows[0][1]
    assert all((out[i].text, out[i]._dropped) == (rows[i][1].split("\n", 1)[1], 1) for i in range(1, 6))


def _dropped_plainly(rows):
    """{doc_id: dropped places}, from the statement of the rules, line by line and with no tree of tables."""
    lines = []
    for i, text in rows:
        for pos, line in enumerate(text.split("\n")):
            raw = [t for t in re.split(r"[ \t\r\f\x0b]+", line) if t]
            even = ["<*>" if re.search("[0-9]", t) else t for t in raw]
            if raw and (len(raw) >= 4 or any(c.isalnum() for t in raw for c in t)):
                whole = len(raw) < 4 or raw != even and sum(t != "<*>" for t in even) < max(4, 0.7 * len(raw))
                lines.append((i, pos, (len(raw), *even[:3]), raw if whole else even, whole))
    at = collections.Counter((leaf, k, t) for _, _, leaf, tokens, _ in lines for k, t in enumerate(tokens) if t != "<*>")
    several = collections.defaultdict(set)
    for (leaf, k, t), n in at.items():
        if n >= 5 and not re.search("[0-9]", t):
            several[leaf, k].add(t)
    narrow, wide = {}, {}
    for i, pos, leaf, tokens, whole in lines:
        if whole:
            narrow[i, pos] = tuple(tokens)
            wide[i, pos] = None
            continue
        n = [at[leaf, k, t] for k, t in enumerate(tokens)]
        n = [None if t == "<*>" or x < 5 else math.inf if several[leaf, k] == {t} else x for k, (t, x) in enumerate(zip(tokens, n))]
        good = sorted((x for x in n if x is not None), reverse=True)
        need = max(4, math.ceil(0.7 * len(tokens)))
        if len(good) >= need:
            narrow[i, pos] = tuple("<*>" if x is None else t for x, t in zip(n, tokens))
            wide[i, pos] = (leaf, *("<*>" if x is None or x < good[need - 1] else t for x, t in zip(n, tokens)))
    def recurring(names, least=5):
        held = collections.defaultdict(list)
        for place, name in names.items():
            held[name].append(place)
        return {name: min(p) for name, p in held.items() if name is not None and len({i for i, _ in p}) >= least}
    own, spread, out = recurring(narrow), recurring(wide), collections.defaultdict(set)
    for place, name in narrow.items():
        first = own.get(name) if name in own else spread.get(wide[place])
        if first is not None and first != place:
            out[place[0]].add(place[1])
    return out


@pytest.mark.parametrize("seed", range(3))
def test_lines_against_plain_rules_and_twin(spark, seed):
    """Random lines of few words, so that short, digit-heavy, wide and narrow templates all recur; the SQL says the same."""
    rng = random.Random(seed)
    words, names = ["user", "logged", "in", "from", "host", "to", "the", "page", "of"], [f"n{chr(97 + k)}{chr(97 + j)}" for k in range(5) for j in range(5)]
    def line():
        kind = rng.randrange(6)
        if kind == 0:
            return " ".join(rng.choice(words) for _ in range(rng.randint(1, 3)))
        if kind == 1:
            return f"user {rng.choice(names)} logged in from host {rng.choice(names)} today"
        if kind == 2:
            return f"{rng.choice(words)}\t{rng.randint(1, 3)} of  {rng.randint(1, 3)}" + rng.choice(["", " 4 5"])
        if kind == 3:
            return rng.choice(["}", "---", "", " ", "é", "<*> a", "Page 1", " Page  1 "])
        if kind == 4:
            return f"the {rng.choice(words)} of page {rng.randint(1, 9)} host {rng.choice(words)}"
        return " ".join(rng.choice(words) for _ in range(rng.randint(4, 6)))
    rows = [(i, "\n".join(line() for _ in range(rng.randint(0, 6)))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r._dropped) for r in line_dedup.dedup_lines(spark, docs).collect()}
    gone = _dropped_plainly(rows)
    assert sum(map(len, gone.values())) > 100
    want = {i: ("\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]), len(gone[i])) for i, t in rows}
    assert got == want
    documents = docs.toPandas()  # noqa: F841
    told = duckdb.sql(f"WITH {line_dedup.dedup_sql()} SELECT doc_id, text, _dropped FROM deduped").fetchall()
    assert {i: (t, n) for i, t, n in told} == want


def test_lines_odd(spark, odd):
    out = line_dedup.dedup_lines(spark, odd)
    assert out.count() == odd.count() and set(odd.columns) <= set(out.columns)
    assert out.where("_dropped > 0").count() == 0 and out.select(*odd.columns).exceptAll(odd).count() == 0
    many = spark.createDataFrame([(1, "one line of five words\nx")] * 9, "doc_id long, text string")
    assert line_dedup.dedup_lines(spark, many).where("_dropped > 0").count() == 0  # one document, repeated


def test_clashing_names_pass_through(spark):
    """Columns named like those the operators use inside keep their values, in the operators and in the stages."""
    names = ["k1", "_k1", "K2", "drops", "m0", "_m1", "rk", "_rk", "pos", "line", "_tokens", "tokens", "_kept", "kept", "p", "_lines", "lines", "dropped", "cls", "sig", "hub"]
    rows = [(i, "the quick brown fox jumps over it\nown %s text" % (chr(97 + i) * 3), "en", "s", 5, *range(i, i + len(names))) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` long" for n in names))
    want = {r[0]: r[5:] for r in rows}
    lines = line_dedup.dedup_lines(spark, docs, n_dropped="gone")
    assert {r.doc_id: r.gone for r in lines.collect()} == {0: 0, **{i: 1 for i in range(1, 8)}}
    for out, but in ((lines, "_lines"), (mixing.mix(spark, docs), "_tokens _kept".split())):
        for r in out.collect():
            assert [r[n] for n in names if n not in but] == [v for n, v in zip(names, want[r.doc_id]) if n not in but]
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and all([r[n] for n in names] == list(want[r.doc_id]) for r in out.collect()), name


def test_stage_keeps_one_row_of_a_repeated_id(spark):
    rows = [(1, "one two three four five six"), (1, "one two three four five six"), (2, "one two three four five six"), (3, "alone"), (4, None), (4, None), (None, "x y"), (None, "x y")]
    out = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted([r.doc_id for r in out], key=str) == [1, 3, 4, 4, None, None]


def test_mixing_meets_its_margins(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randrange(50, 150), rng.choice(["en", "en", "de"]), rng.choice("abbbbbb"), 0) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = mixing.mix(spark, docs, take=0.3, powers={"source": 0.0, "lang": 1.0, "topic": 1.0}).groupBy("source").agg(F.sum(F.col("_p") * F.col("_tokens")).alias("e"), F.sum(F.when(F.col("_kept"), F.col("_tokens"))).alias("k"), F.max("_p").alias("p"), F.sum("_tokens").alias("t")).collect()
    by, total = {r.source: r for r in out}, sum(r.t for r in out)
    assert abs(sum(r.e for r in out) / total - 0.3) < mixing.TOLERANCE
    assert abs(by["a"].e - min(by["a"].t, 0.15 * total)) < mixing.TOLERANCE * total
    assert all(abs(r.k - r.e) < 0.15 * r.e for r in out)
    given = {"source": spark.createDataFrame([("=a", 1.0)], "source string, share double")}
    assert mixing.mix(spark, docs, given=given).where("source = 'b' AND _kept").count() == 0


def test_mixing_deals_out_what_a_value_does_not_hold(spark):
    tokens = {("=a", "=x"): 100, ("=a", "=y"): 100, ("=b", "=x"): 3000, ("=b", "=y"): 900, ("=c", "=x"): 900, ("=c", "=y"): 5000}
    cells = spark.createDataFrame([(s, v, "=t", n) for (s, v), n in tokens.items()], "source string, lang string, topic string, t long")
    fitted = mixing.rake(Workspace(spark, "rake"), cells, 0.5, {"source": 0.0, "lang": 1.0, "topic": 1.0})
    rows = {(r.margin, r.value): r for r in mixing.achieved(fitted).collect()}
    # a third each is wanted of 5000: a holds 200 only, so b and c give 2400
    goals = {("source", "=a"): 200, ("source", "=b"): 2400, ("source", "=c"): 2400, ("lang", "=x"): 2000, ("lang", "=y"): 3000, ("topic", "=t"): 5000}
    assert {k: round(r.goal, 6) for k, r in rows.items()} == goals
    assert all(abs(r.expected - r.goal) <= mixing.TOLERANCE * 10000 for r in rows.values())

    # the same by plain scaling of numbers
    p = {k: 0.5 for k in tokens}
    miss = 1.0
    while miss > mixing.TOLERANCE:
        miss = 0.0
        for (m, value), goal in goals.items():
            own = [k for k in tokens if value == "=t" or value in k]
            now = sum(tokens[k] * min(1, p[k]) for k in own)
            miss = max(miss, abs(now - goal) / 10000)
            p |= {k: p[k] * goal / now for k in own}
    assert all(abs(min(1.0, r.f) - min(1, p[r.source, r.lang])) < 1e-9 for r in fitted.collect())

    short = mixing.rake(Workspace(spark, "rake"), cells, 0.5, mixing.POWERS, {"source": spark.createDataFrame([("=a", 1.0)], "source string, share double")}, sweeps=5)
    assert {r.value: (r.goal, r.expected) for r in mixing.achieved(short).where("margin = 'source'").collect()} == {"=a": (200.0, 200.0), "=b": (0.0, 0.0), "=c": (0.0, 0.0)}


def test_mixing_odd(spark, odd, none):
    out = mixing.mix(spark, odd)
    assert out.count() == odd.count() and out.where("_p IS NULL OR _kept IS NULL OR _p < 0 OR _p > 1").count() == 0
    assert mixing.mix(spark, none).collect() == []
    assert mixing.mix(spark, odd.where("text IS NULL")).where("_kept").count() == 0


def test_url_rules(spark):
    def rule(host, path):
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1:] if fits else (None, None)

    urls = [None, "", "no scheme", "http://", "http://ORG", "http://a.org/x", "https://Example.ORG/es/1", "x://b.example.org/en/12?q", "x://b.example.org/en/2#f", "http://com/fr/", "http://a.com?x=/fr/", "http://acom/fr/x", "http://x.com/de/1", "http://u@x.net:80/a/b", "a://b://c", "http://x.net/" + "a/" * 50, "http://É.org/"]
    want = {}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        k = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = rest[:k], rest[k:]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
        want[i] = (host, path, *rule(host, path))
    got = url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)) * 2, "page_id long, url string")).collect()
    assert len(got) == 2 * len(urls)
    for r in got:
        host, path, name, verdict = want[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, name) and r.verdict in (("allow", "block") if name is None else (verdict,))
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string")).collect() == []
    assert url_filter.filter_urls(spark.createDataFrame([(1, "http://a/b")], "page_id long, url string"), rules=[]).first().rule is None


def alike_parts(branches):
    """branches: (labelled, allowed, name), cut until the branches of each part scatter no more than chance makes one chance scatter."""
    n, a = sum(b[0] for b in branches), sum(b[1] for b in branches)
    p, df = a / n, len(branches) - 1
    if not df or not 0 < p < 1:
        return [branches]
    x2 = sum((ca - cn * p) ** 2 / (cn * p * (1 - p)) for cn, ca, _ in branches)
    if ((x2 / df) ** (1 / 3) - (1 - 2 / (9 * df))) / (2 / (9 * df)) ** 0.5 <= url_filter.Z:
        return [branches]
    kinds = sorted({b[:2] for b in branches}, key=lambda c: (c[1] / c[0], c[0]))
    best = (-1, None)
    for k in range(1, len(kinds)):
        low = [b for b in branches if b[:2] in set(kinds[:k])]
        un, ua = sum(b[0] for b in low), sum(b[1] for b in low)
        best = max(best, ((float(ua) * n - float(un) * a) ** 2 / (float(un) * (n - un)), -k))
    low = set(kinds[: -best[1]])
    return alike_parts([b for b in branches if b[:2] in low]) + alike_parts([b for b in branches if b[:2] not in low])


def plain_tree(urls, rules):
    """The verdict, template and counts of each (host, segments, label), by plain recursion."""
    total = (sum(v == "allow" for *_, v in urls) + 1) / (sum(v is not None for *_, v in urls) + 2)
    out = {}

    def counts(rows):
        return sum(v is not None for *_, v in rows), sum(v == "allow" for *_, v in rows)

    def grow(rows, depth, t, p):
        n, a = counts(rows)
        heads = collections.defaultdict(list)
        for r in rows:
            heads[r[1][depth] if len(r[1]) > depth and 0 < a < n else None].append(r)
        for r in heads.pop(None, []):
            out[r[0], tuple(r[1])] = ("block" if p < 0.5 else "allow", t, n, a)
        told = {h: counts(own) for h, own in heads.items()}
        groups = [(["*"], [h for h, c in told.items() if not c[0]])]
        labelled = [(*c, h) for h, c in told.items() if c[0]]
        for g, part in enumerate(alike_parts(labelled) if labelled else []):
            groups.append(([part[0][2] if len(part) == 1 else f"*{g}"], [h for *_, h in part]))
        for (name,), members in groups:
            if not members:
                continue
            rows_in = [r for h in members for r in heads[h]]
            tn, ta = counts(rows_in)
            grow(rows_in, depth + 1, f"{t}/{name}", p if tn == n else (ta + 4 * p) / (tn + 4))

    for host in {r[0] for r in urls}:
        own = [r for r in urls if r[0] == host]
        n, a = counts(own)
        grow(own, 0, "", (a + 4 * total) / (n + 4))
    return out


def test_url_tree_equals_plain_recursion(spark):
    rng = random.Random(8)
    names = ["fr", "de", "news", "casino", "x", "y", "p1"]
    paths = {"/" + "/".join(rng.choice(names) for _ in range(rng.choice([0, 1, 2, 3, 5, 7]))) for _ in range(900)}
    rules = [("allow", "a.com", "/fr"), ("block", "a.com", "/de/x"), ("block", "a.com", "/news/casino"), ("allow", "a.com", "/news/fr"), ("allow", "b.com", "/x/y/x"), ("block", "b.com", "/x/y/de"), ("block", "b.com", "/casino")]
    rows = [(h, p) for h in ("a.com", "b.com", "c.com") for p in sorted(paths)]
    fits = lambda h, p: max([(len(x + y), v) for v, x, y in rules if h == x and p.startswith(y)], default=(0, None))[1]
    want = plain_tree([(h, [s for s in p.split("/") if s], fits(h, p)) for h, p in rows], rules)
    got = url_filter.filter_urls(spark.createDataFrame([(i, f"http://{h}{p}") for i, (h, p) in enumerate(rows)], "page_id long, url string"), rules=rules).collect()
    for r in got:
        verdict, t, n, a = want[r.host, tuple(s for s in r.path.split("/") if s)]
        assert (r.template, r.n_labelled, r.n_allowed) == (t, n, a) and (r.rule or r.verdict == verdict)
    assert {t.count("/") for _, t, _, _ in want.values()} >= {0, 1, 2}


def test_url_tree_learns_branches(spark):
    urls = [f"http://x.com/{lang}/page{i}" for lang in ("fr", "de", "it") for i in range(40)] + [f"http://x.com/fr/{i}" for i in range(40)]
    rules = [("allow", "x.com", "/fr/page"), ("block", "x.com", "/de/"), ("allow", "x.com", "/it/page1")]
    got = url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules=rules).where("rule IS NULL").groupBy(F.regexp_extract("path", "^/(..)", 1).alias("l")).agg(F.min("verdict").alias("lo"), F.max("verdict").alias("hi")).collect()
    assert {r.l: (r.lo, r.hi) for r in got} == {"fr": ("allow", "allow"), "it": ("allow", "allow")}


@pytest.mark.parametrize("width", [3, 32, 33, 400])
def test_url_tree_keeps_significant_branches_of_wide_nodes(spark, width):
    urls = [f"http://x.com/d{k}/page{i}" for k in range(width - 1) for i in range(2)] + [f"http://x.com/bad/page{i}" for i in range(60)] + ["http://x.com/bad/free"]
    rules = [("block", "x.com", "/bad/page"), ("allow", "x.com", "/d")]
    got = url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules=rules).collect()
    assert [(r.verdict, r.template, r.n_labelled, r.n_allowed) for r in got if r.rule is None] == [("block", "/bad", 60, 0)]
    assert {r.template for r in got if r.rule == "x.com/d"} == {"/*1"}


def test_url_branches_of_one_chance_are_one(spark):
    """Ten thousand branches of ten labelled URLs each, allowed by a coin; and half of them by another coin."""
    rng = random.Random(5)
    for chances, most in (([0.5], 1), ([0.1, 0.9], 2)):
        rows = [("h", "", f"d{k}", 10, sum(rng.random() < chances[k % len(chances)] for _ in range(10)), chances[k % len(chances)]) for k in range(10_000)]
        child = spark.createDataFrame(rows, "host string, t string, head string, cn long, ca long, chance double")
        to = url_filter.merged(Workspace(spark, "test"), child.drop("chance"), ["host", "t"])
        got = child.join(to, ["host", "t", "cn", "ca"]).groupBy("g", "chance").count().collect()
        assert len({r.g for r in got}) == most
        if most == 2:
            assert sum(max(r["count"] for r in got if r.g == g) for g in (0, 1)) > 9_900


def test_url_branches_that_differ_stay_apart(spark):
    """Eleven directories with 0, 1, .., 10 of 10 labelled URLs allowed: the ends never meet, and what stands in them is judged by them."""
    urls = [f"http://x.com/d{k}/{'ok' if i < k else 'no'}{i}" for k in range(11) for i in range(10)] + [f"http://x.com/d{k}/free" for k in (0, 10)]
    rules = [("allow", "x.com", f"/d{k}/ok") for k in range(11)] + [("block", "x.com", f"/d{k}/no") for k in range(11)]
    got = {r.path: r for r in url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules=rules).collect()}
    assert (got["/d0/free"].verdict, got["/d10/free"].verdict) == ("block", "allow")
    assert got["/d0/free"].template.split("/")[1] != got["/d10/free"].template.split("/")[1]


def test_url_tree_learns_below_its_first_levels(spark):
    """Labels that differ after the third segment, after a long common run, and a path far longer than the others."""
    kinds = {"/a/b/c/casino/": "block", "/a/b/c/news/": "allow", "/blog/2024/05/x/y/z/casino/": "block", "/blog/2024/05/x/y/z/news/": "allow"}
    urls = [f"http://x.com{k}{w}" for k in kinds for w in [f"page{i}" for i in range(30)] + ["free"]]
    urls += ["http://x.com/a/b/c/news/free" + "/a" * 300, "http://x.com/a/b/c", "http://y.com/a/b/c/d/e/f"]
    rules = [(v, "x.com", k + "page") for k, v in kinds.items()]
    got = url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules=rules).collect()
    assert len(got) == len(urls)
    by = {r.path: r for r in got if r.rule is None}
    for k, v in kinds.items():
        assert by[k + "free"].verdict == v and (by[k + "free"].n_labelled, by[k + "free"].n_allowed) in ((30, 30 * (v == "allow")), (60, 60 * (v == "allow")))
    assert by["/a/b/c/news/free" + "/a" * 300].verdict == "allow" and by["/a/b/c/d/e/f"].template == ""


HEAD = "record_id long, url string, ts long, kind string, status int, headers map<string,string>, digest string"


def test_revisits(spark):
    h = {"etag": '"1"', "content-length": "9", "x-old": "o"}
    rows = [(1, "http://www.a.net/p/?b=2&a=1&utm_source=f#x", 10, "response", 200, h, "d1"), (2, "https://a.net/p?a=1&b=2", 20, "revisit", 304, {"etag": 'W/"1"', "content-length": "0", "x-new": "n", "connection": "close"}, None), (3, "https://a.net/p?a=1&b=2", 5, "revisit", 304, {}, None), (4, "http://a.net/p?a=1&b=2", 30, "revisit", 304, {"etag": '"2"'}, None), (5, "http://a.net/p?a=1&b=2", 40, "revisit", 304, {"date": "z"}, None), (6, None, 50, "revisit", 304, None, None), (7, "http://a.net/p?a=1&b=2", 35, "response", 404, h, "d7"), (8, "http://a.net/p?a=1&b=2", None, "revisit", 304, {}, None), (None, "http://a.net/p?a=1&b=2", 60, "revisit", 304, {}, None), (9, "http://a.net/p?a=1&b=2", 10, "revisit", 304, {}, None), (0, "http://a.net/p?a=1&b=2", 10, "revisit", 304, {}, None)]
    got = {r.record_id: r for r in revisits.resolve(spark, spark.createDataFrame(rows, HEAD)).collect()}
    assert {i: (r.state, r.refers_to) for i, r in got.items()} == {1: ("full", None), 2: ("resolved", 1), 3: ("missing", None), 4: ("mismatch", None), 5: ("unchecked", 1), 6: ("missing", None), 7: ("other", None), 8: ("missing", None), None: ("missing", None), 9: ("unchecked", 1), 0: ("missing", None)}
    assert got[2].headers == {"etag": 'W/"1"', "content-length": "9", "x-old": "o", "x-new": "n"} and got[2].digest == "d1"
    assert got[4].digest is None
    assert revisits.resolve(spark, spark.createDataFrame([], HEAD)).collect() == []


def test_revisits_of_one_hot_url(spark):
    """One URL over all parts of the range partitioning: the latest full response is carried across them."""
    rng = random.Random(6)
    rows = [(i, "http://a.net/", t, *(("response", 200, {}, f"d{i}") if rng.random() < 0.02 else ("revisit", 304, {}, None))) for i, t in enumerate(sorted(rng.randrange(3000) for _ in range(4000)))]
    last, want = None, {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        if r[3] == "revisit":
            want[r[0]] = last
        else:
            last = r[0]
    got = {r.record_id: r.refers_to for r in revisits.resolve(spark, spark.createDataFrame(rows, HEAD)).where("kind = 'revisit'").collect()}
    assert got == want


# --- classifiers


@tables
def test_quality_on_held_out_rows(spark):
    d = D.replace("0.001", "0.01")
    docs, lab = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = quality.judge_quality(spark, docs, lab)
    rows = got.collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    y = {r.doc_id: r.quality for r in lab.collect()}
    held = [r for r in rows if r.held_out and r.doc_id in y]
    assert sum(r.predicted == y[r.doc_id] for r in held) >= 0.95 * len(held)
    again = {r.doc_id: r.score for r in quality.judge_quality(spark, docs.withColumn("lang", F.lit("x")), lab.where(~quality.held_out(F.col("doc_id")))).collect()}
    assert all(again[r.doc_id] == r.score for r in rows)  # neither held-out labels nor other columns matter


@tables
def test_toxicity_on_held_out_rows(spark):
    d = D.replace("0.001", "0.1")
    docs, lab = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    y = {r.doc_id: r.toxic for r in lab.collect()}
    got = toxicity.judge_toxicity(spark, docs.join(lab.select("doc_id"), "doc_id"), lab).where(quality.held_out(F.col("doc_id"))).collect()
    toxic, clean = [r for r in got if y[r.doc_id]], [r for r in got if not y[r.doc_id]]
    assert sum(r.toxic for r in toxic) >= 0.85 * len(toxic) and sum(r.toxic for r in clean) <= 0.02 * len(clean)


@tables
def test_quality_equals_a_plain_scorer(spark):
    """Scores of all rows, by adding a table's value for each feature and pair of a text, one row at a time."""
    d = D.replace("0.001", "0.01")
    docs, lab = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality.train(spark, docs, lab)
    got = {r.doc_id: r.score for r in quality.judge_quality(spark, docs, lab).collect()}
    assert model.pairs and any(t.any() for t in model.tables)
    for r in docs.collect():
        x, f = quality.features((r.text or "").encode()), model.intercept
        place = lambda borders, v: sum(b <= v for b in borders)
        f += sum(t[place(b, v)] for t, b, v in zip(model.tables, model.borders, x))
        f += sum(t[place(model.coarse[i], x[i])][place(model.coarse[j], x[j])] for i, j, t in model.pairs)
        assert abs(got[r.doc_id] - 1 / (1 + math.exp(-f))) < 1e-9
    text = "Ab c1! | c1!\nZZ é.\nAb c1! | c1!"
    plain = {"words": math.log(11), "upper_words": 1 / 10, "bars": 2 / 10, "bangs": 4 / 10, "stops": 1 / 10, "distinct": 5 / 10, "same_lines": 1 / 3, "long_words": math.log(4)}
    assert all(abs(dict(zip(quality.FEATURES, quality.features(text.encode())))[k] - v) < 1e-9 for k, v in plain.items())


@tables
def test_toxicity_equals_a_plain_chain(spark):
    """Probabilities of all rows, link by link and word by word."""
    d = D.replace("0.001", "0.01")
    docs, lab = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    chain = toxicity.train(spark, docs, lab)
    got = {r.doc_id: [r[f"p_{n}"] for n in chain.names] for r in toxicity.judge_toxicity(spark, docs, lab).collect()}
    assert chain.names == ["poor", "kind_1", "kind_2", "kind_3", "toxic"]
    for r in docs.collect():
        words = set(re.sub(rb"[^a-zA-Z\x80-\xff]", b" ", (r.text or "").encode()).lower().split())
        words |= {b"^" + w[:k] for w in words for k in (4, 6) if len(w) > k}
        has, before = [float(w in words) for w in chain.words], []
        for weights in chain.weights:
            z = sum(a * b for a, b in zip(weights, has + before)) + weights[-1]
            before.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
        assert all(abs(a - b) < 1e-9 for a, b in zip(got[r.doc_id], before))


def test_kinds_part_the_toxic_rows():
    rng = np.random.RandomState(2)
    which = np.arange(90) % 3
    x = np.concatenate([np.repeat(np.eye(3)[which], 4, axis=1) * (rng.rand(90, 12) < 0.8), rng.rand(60, 12) < 0.1])
    y = np.r_[np.ones(90), np.zeros(60)]
    kinds = toxicity.kinds_of(x.astype(float), y)
    assert (sum(kinds) == y).all() and {tuple(np.unique(which[k[:90] == 1])) for k in kinds} == {(0,), (1,), (2,)}


@pytest.mark.parametrize("train", [quality.train, toxicity.train])
def test_training_does_not_depend_on_the_order_of_rows(spark, train):
    rng = random.Random(9)
    rows = [(i % 40, " ".join(rng.choices(["good", "bad!", "1", "|", "vile", "x."], k=rng.randrange(1, 30)))) for i in range(160)]
    labels = spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    make = lambda r, n: spark.createDataFrame(r, "doc_id long, text string").repartition(n)
    column = "quality" if train is quality.train else "toxic"
    a, b = (train(spark, make(r, n), labels, column, 20) for r, n in ((rows, 3), (rows[::-1], 5)))
    assert all((x == y).all() for x, y in zip(a.tables if column == "quality" else a.weights, b.tables if column == "quality" else b.weights))


def test_chain_uses_out_of_fold_probabilities():
    rng = np.random.RandomState(0)
    x = (rng.rand(300, 5) < 0.3).astype(float)
    y1 = x[:, 0]
    chain = toxicity.fit_chain(x, [y1, np.maximum(y1, x[:, 1])], ["a", "b"], [b"v"] * 5, np.arange(300) % 3)
    p = chain.predict(x)
    assert p.shape == (300, 2) and len(chain.weights[1]) == len(chain.weights[0]) + 1
    assert ((p[:, 1] > 0.5) == np.maximum(y1, x[:, 1])).mean() > 0.98


def test_links_learn_only_from_rows_with_their_label():
    """Rows without a target change no weight of its link, whatever they hold, but are fed its probability like all others."""
    rng = np.random.RandomState(1)
    x = (rng.rand(200, 4) < 0.4).astype(float)
    known = rng.rand(200) < 0.5
    y1, y2, folds = np.where(known, x[:, 0], np.nan), x[:, 1], np.arange(200) % 3
    chain = toxicity.fit_chain(x, [y1, y2], ["a", "b"], [b"v"] * 4, folds)
    assert (chain.weights[0] == toxicity.logistic(x[known], x[known, 0])).all() and not np.isnan(chain.weights[1]).any()
    p = chain.predict(x)
    assert ((p[:, 0] > 0.5) == (x[:, 0] == 1)).all()
    none = toxicity.fit_chain(x, [np.full(200, np.nan), y2], ["a", "b"], [b"v"] * 4, folds)
    assert none.predict(x)[:, 0].max() < 1e-3


def test_classifiers_odd(spark, odd, none, labels):
    n = odd.count()
    for judge in (quality.judge_quality, toxicity.judge_toxicity):
        assert judge(spark, odd, labels).count() == n
        assert judge(spark, odd, labels.limit(0)).count() == n
        assert judge(spark, none, labels).collect() == []
    assert toxicity.judge_toxicity(spark, odd, labels.limit(0)).where("toxic = 1").count() == 0


# --- pipeline and twins


def test_stages_stand_odd_rows(spark, odd, none, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (odd, none):
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            assert i == 4 or out.columns == docs.columns, name
            out.count()


@tables
def test_pipeline(spark):
    docs = table(spark, "documents")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, seen[-1], D)
        assert out.schema.names == docs.columns
        out.write.parquet(path := Workspace(spark, "t").path(name))
        seen.append(spark.read.parquet(path))
    counts = [x.count() for x in seen]
    assert counts == sorted(counts, reverse=True) and counts[3] > 0.7 * counts[0]
    sets = {r.doc_id: shingles(r.text, 5) for r in seen[2].collect()}
    want = {i for i, c in components(sets, 4, 5).items() if i == c}
    assert {r.doc_id for r in seen[3].collect()} == want
    assert corpus_pipeline.run(spark, D).count() > 0


@tables
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twin(spark, name):
    c = duckdb.connect()
    for p in glob.glob(f"{D}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    df = queries.QUERIES[name](spark, D)
    r = c.execute(queries.ORACLES[name])
    names, cols = [x[0] for x in r.description], sorted(df.columns)
    assert sorted(names) == cols
    assert sorted(repr([x[k] for k in cols]) for x in df.collect()) == sorted(repr([x[names.index(k)] for k in cols]) for x in r.fetchall())
