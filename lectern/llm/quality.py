"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a whole text are cut into quantile bins.  Boosting visits the
features in turn; each visit fits a shallow tree on one feature's bins to the
current gradient and adds it, damped, to that feature's lookup table.  Then the
pairs with the largest gain on what is left get tables over a coarser grid in
the same way.  A score is an intercept plus table lookups, added for whole
batches at once.

The model is fitted on the driver from at most max_train labelled rows, picked by
a hash of their id; ids whose crc32 leaves remainder 2 by 4 are never learned from.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.workspace import small_batches

FEATURES = ("words", "word_length", "upper_words", "symbols", "bars", "bangs", "digits", "stops", "distinct", "distinct_pairs", "repeats", "line_length", "same_lines", "long_words", "upper_letters", "wide")
_SYMBOLS, _DIGITS, _UPPER = b"#$%&*~^=<>@_+\\{}[]", b"0123456789", bytes(range(65, 91))
#: Labelled rows to learn from at most; bins of a feature, of a pair's side; rounds; pairs; step; ridge on a leaf; least rows in a leaf.
MAX_TRAIN, BINS, GRID, ROUNDS, PAIRS, RATE, RIDGE, LEAF = 20_000, 48, 10, 150, 4, 0.1, 2.0, 8


def features(text: bytes) -> list[float]:
    """Of a whole UTF-8 text; an empty one gives zeros."""
    words = text.split()
    n, size = len(words), max(1, len(text))
    if not n:
        return [0.0] * len(FEATURES)
    lines = text.split(b"\n")
    without = lambda drop: (len(text) - len(text.translate(None, drop))) / size
    return [np.log1p(n), len(text) / n, sum(map(bytes.isupper, words)) / n, without(_SYMBOLS), text.count(b"|") / n, text.count(b"!") / n, without(_DIGITS), text.count(b".") / n, len(set(words)) / n, len(set(zip(words, words[1:]))) / n, sum(map(eq, words, words[1:])) / n, np.log1p(size / len(lines)), 1 - len(set(lines)) / len(lines), np.log1p(max(map(len, words))), without(_UPPER), 1 - len(text.decode("utf-8", "replace")) / size]


def _tree(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Leaf values over the cells of g and h (one or two axes): splits at bin borders, greedily."""
    out = np.zeros(g.shape)

    def grow(box, left):
        a, b = g[box], h[box]
        G, H = a.sum(), b.sum()
        best = (0.0, None)
        for axis in range(g.ndim) if left else ():
            ga, hb = (np.cumsum(x.sum(tuple(i for i in range(g.ndim) if i != axis)))[:-1] for x in (a, b))
            if len(ga):
                ok = (hb > LEAF / 8) & (H - hb > LEAF / 8)
                gain = np.where(ok, ga**2 / (hb + RIDGE) + (G - ga) ** 2 / (H - hb + RIDGE) - G**2 / (H + RIDGE), 0)
                k = int(gain.argmax())
                if gain[k] > best[0] + 1e-12:
                    best = (gain[k], (axis, k + 1))
        if best[1] is None:
            out[box] = -G / (H + RIDGE)
            return
        axis, k = best[1]
        s = box[axis]
        for part in (slice(s.start, s.start + k), slice(s.start + k, s.stop)):
            grow(tuple(part if i == axis else x for i, x in enumerate(box)), left - 1)

    grow(tuple(slice(0, n) for n in g.shape), depth)
    return out


class Additive:
    """The fitted model: borders, a table a feature, and (i, j, table) for each pair."""

    def __init__(self, intercept: float, borders: list[np.ndarray], tables: list[np.ndarray], coarse: list[np.ndarray], pairs: list[tuple[int, int, np.ndarray]]):
        self.intercept, self.borders, self.tables, self.coarse, self.pairs = intercept, borders, tables, coarse, pairs

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        f = np.full(len(x), self.intercept)
        for i, t in enumerate(self.tables):
            f += t[np.searchsorted(self.borders[i], x[:, i], "right")]
        for i, j, t in self.pairs:
            f += t[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-f))


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """y in {0, 1}.  No rows, or one label only: the smoothed base rate for every text."""
    k = x.shape[1]
    rate = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(rate / (1 - rate)))
    if len(set(y.tolist())) < 2:
        return Additive(start, [np.empty(0)] * k, [np.zeros(1)] * k, [np.empty(0)] * k, [])
    cuts = lambda v, n: np.unique(np.quantile(v, np.linspace(0, 1, n + 1)[1:-1]))
    borders, coarse = [cuts(x[:, i], BINS) for i in range(k)], [cuts(x[:, i], GRID) for i in range(k)]
    at = [np.searchsorted(borders[i], x[:, i], "right") for i in range(k)]
    rough = [np.searchsorted(coarse[i], x[:, i], "right") for i in range(k)]
    tables, f = [np.zeros(len(b) + 1) for b in borders], np.full(len(y), start)

    def slopes():
        p = 1 / (1 + np.exp(-f))
        return p - y, p * (1 - p)

    for _ in range(ROUNDS):
        for i in range(k):
            g, h = slopes()
            n = len(tables[i])
            step = RATE * _tree(np.bincount(at[i], g, n), np.bincount(at[i], h, n), 2)
            tables[i] += step
            f += step[at[i]]
    shape = [len(c) + 1 for c in coarse]

    def grid(i, j):
        g, h = slopes()
        flat = rough[i] * shape[j] + rough[j]
        return (np.bincount(flat, v, shape[i] * shape[j]).reshape(shape[i], shape[j]) for v in (g, h))

    gains = []
    for i in range(k):
        for j in range(i + 1, k):
            g, h = grid(i, j)
            gains.append((-float((g**2 / (h + RIDGE)).sum()), i, j))
    pairs = [(i, j, np.zeros((shape[i], shape[j]))) for _, i, j in sorted(gains)[:PAIRS]]
    for _ in range(ROUNDS // 3):
        for i, j, t in pairs:
            step = RATE * _tree(*grid(i, j), 2)
            t += step
            f += step[rough[i], rough[j]]
    return Additive(start, borders, tables, coarse, pairs)


def _measure(batches):
    for b in batches:
        x = [features(t.as_py() or b"") for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "y", "x"])


def _matrix(texts) -> np.ndarray:
    return np.array([features(t.as_py() or b"") for t in texts], np.float64).reshape(-1, len(FEATURES))


def _score(model: Additive):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(_matrix(b.column("text"))), pa.float64())], ["doc_id", "score"])

    return run


def _keep(model: Additive, cut: float):
    def run(batches):
        for b in batches:
            texts = [t.as_py().encode() if t.is_valid else b"" for t in b.column("text")]
            x = np.array([features(t) for t in texts], np.float64).reshape(-1, len(FEATURES))
            yield b.filter(pa.array(model.score(x) >= cut, pa.bool_()))

    return run


def held_out(doc_id: Column) -> Column:
    """True for ids whose crc32, of the id as text, leaves remainder 2 by 4; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, column: str, most: int) -> DataFrame:
    """(doc_id, text, y) of the rows of at most `most` ids with a label of 0 or 1 that may be learned from; an id labelled twice counts by its larger label."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("double").alias("y")).where(F.col("y").isin(0.0, 1.0) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    own = own.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).join(F.broadcast(own), "doc_id")  # at most `most` rows


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, column: str = "quality", max_train: int = MAX_TRAIN) -> Additive:
    """From at most max_train labelled ids; of rows that repeat an id the least features count."""
    small_batches(spark)
    measured = labelled(docs, labels, column, max_train).mapInArrow(_measure, "doc_id long, y double, x array<double>")
    rows = measured.groupBy("doc_id").agg(F.max("y").alias("y"), F.min("x").alias("x")).orderBy("doc_id").collect()
    x = np.array([r.x for r in rows], np.float64).reshape(-1, len(FEATURES))
    return fit(x, np.array([r.y for r in rows], np.float64))


def keep_quality(spark: SparkSession, docs: DataFrame, model: Additive, cut: float = 0.7) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores at least cut; a null text scores as an empty one."""
    small_batches(spark)
    return docs.mapInArrow(_keep(model, cut), docs.schema)


def judge_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, cut: float = 0.7, max_train: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs; repeated rows and null ids are kept row by row, other columns are not looked at."""
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    scored = rows.mapInArrow(_score(train(spark, docs, labels, "quality", max_train)), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
