"""Toxicity by a classifier chain.

Categories are predicted one after another; each linear (logistic) model sees the
words of a text and the probabilities that the chain gave for the categories
before it.  For training, those probabilities come from models that did not see
the row (out of fold), so later links meet inputs like those at scoring time.

The first link is the labelled quality (poor or not; only rows that have that label
teach it) and the last one the labelled toxicity.  The kinds between them are learned: the words that tell toxic from other
rows best (chi-square on document counts over the sample) describe the toxic rows,
and these are parted into KINDS groups by those words, whatever their language.  A
row is of a kind if it is toxic and of that group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.quality import labelled
from lectern.llm.workspace import Workspace, small_batches

#: Kinds of toxic rows that are learned, words that describe them, rounds of parting them.
KINDS, KIND_WORDS, KIND_ROUNDS = 3, 64, 10
#: Labelled rows to learn from at most, words used, folds, ridge, least documents with a word.
MAX_TRAIN, WORDS, FOLDS, RIDGE, LEAST = 10_000, 256, 3, 0.1, 4
#: Bytes of the beginnings of words that count as features.
BEGIN = (4, 6)
_SPLIT = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def words_of(text: bytes) -> set[bytes]:
    """Distinct runs of letters of a UTF-8 text, A-Z lower-cased, and their beginnings, marked '^': inflected and made-up forms share those."""
    words = set(text.lower().translate(_SPLIT).split())
    return words.union(*({b"^" + w[:k] for w in words if len(w) > k} for k in BEGIN))


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the intercept, not penalised.  Without a positive row: next to nothing for every text."""
    x = np.hstack([x, np.ones((len(x), 1))])
    if not y.any():
        return np.append(np.zeros(x.shape[1] - 1), -10.0)
    w, pen = np.zeros(x.shape[1]), np.full(x.shape[1], RIDGE)
    pen[-1] = 1e-3
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pen), x.T @ (p - y) + pen * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _apply(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


class Chain:
    def __init__(self, names: list[str], words: list[bytes], weights: list[np.ndarray]):
        self.names, self.words, self.weights = names, words, weights
        self.at = {w: i for i, w in enumerate(words)}

    def matrix(self, texts: list[bytes]) -> np.ndarray:
        x = np.zeros((len(texts), len(self.words)))
        for i, t in enumerate(texts):
            for w in self.at.keys() & words_of(t):
                x[i, self.at[w]] = 1
        return x

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (rows, categories), each link fed with those before it."""
        out = np.zeros((len(x), 0))
        for w in self.weights:
            out = np.hstack([out, _apply(w, np.hstack([x, out]))[:, None]])
        return out


def fit_chain(x: np.ndarray, targets: list[np.ndarray], names: list[str], words: list[bytes], folds: np.ndarray) -> Chain:
    """A link learns from the rows whose target is a number; the others (NaN) get its probability like rows of another fold."""
    before, weights = np.zeros((len(x), 0)), []
    for y in targets:
        z = np.hstack([x, before])
        known = ~np.isnan(y)
        weights.append(logistic(z[known], y[known]))
        unseen = np.zeros(len(y))
        for k in range(FOLDS):
            out = folds == k
            if out.any():
                unseen[out] = _apply(logistic(z[known & ~out], y[known & ~out]), z[out])
        before = np.hstack([before, unseen[:, None]])
    return Chain(names, words, weights)


def kinds_of(x: np.ndarray, y: np.ndarray, kinds: int = KINDS) -> list[np.ndarray]:
    """For each kind 1 for the toxic rows (y) that belong to it: means of unit rows of x, begun with the row farthest from those before, ties by place."""
    own = np.flatnonzero(y)
    out = [np.zeros(len(y)) for _ in range(kinds)]
    if not len(own) or not x.shape[1]:
        return out
    u = x[own] / np.maximum(1e-12, np.linalg.norm(x[own], axis=1, keepdims=True))
    picked = [int(np.abs(u).sum(1).argmax())]
    while len(picked) < min(kinds, len(own)):
        picked.append(int((u @ u[picked].T).max(1).argmin()))
    means = u[picked]
    for _ in range(KIND_ROUNDS):
        group = (u @ means.T).argmax(1)
        means = np.stack([u[group == k].mean(0) if (group == k).any() else means[k] for k in range(len(means))])
        means /= np.maximum(1e-12, np.linalg.norm(means, axis=1, keepdims=True))
    for k in range(len(means)):
        out[k][own[group == k]] = 1
    return out


def _words(batches):
    for b in batches:
        w = [sorted(words_of(t.as_py() or b"")) for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(w, pa.list_(pa.binary()))], ["doc_id", "y", "words"])


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, column: str = "toxic", max_train: int = MAX_TRAIN) -> Chain:
    """From at most max_train labelled ids; none, or no toxic one: a chain that knows no word.  Of rows that repeat an id the least set of words counts."""
    small_batches(spark)
    rows = labelled(docs, labels, column, max_train).mapInArrow(_words, "doc_id long, y double, words array<binary>")
    rows = Workspace(spark, "toxic").write(rows.groupBy("doc_id").agg(F.max("y").alias("y"), F.min("words").alias("words")), "sample")
    n, bad = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    count = rows.select("y", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df"), F.sum("y").alias("a")).where(F.col("df") >= LEAST)
    rate = bad / n if n else 0.0
    odd = (F.col("a") - F.col("df") * rate) / F.sqrt(F.col("df") * F.lit(max(rate * (1 - rate), 1e-9)) + 1)
    words = [bytes(r.word) for r in count.orderBy(F.abs(odd).desc(), "word").limit(WORDS).collect()]
    poor = labels.where(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") == 0).cast("double").alias("poor"))
    held = rows.select("doc_id", "y", F.array_intersect("words", F.array(*(F.lit(w) for w in words)).cast("array<binary>")).alias("words")).join(poor, "doc_id", "left").orderBy("doc_id").collect()  # at most max_train rows
    chain = Chain(["poor", *(f"kind_{k + 1}" for k in range(KINDS)), column], words, [])
    x, y = np.zeros((len(held), len(words))), np.array([r.y for r in held])
    for i, r in enumerate(held):
        for w in map(bytes, r.words):
            x[i, chain.at[w]] = 1
    targets = [np.array([np.nan if r.poor is None else r.poor for r in held]), *kinds_of(x[:, :KIND_WORDS], y), y]
    return fit_chain(x, targets, chain.names, words, np.arange(len(held)) % FOLDS)


def _score(chain: Chain):
    def run(batches):
        for b in batches:
            p = chain.predict(chain.matrix([t.as_py() or b"" for t in b.column("text")]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(p[:, i], pa.float64()) for i in range(len(chain.names)))], ["doc_id", *(f"p_{n}" for n in chain.names)])

    return run


def judge_toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, cut: float = 0.35, max_train: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, p_<category>..., toxic) for every row of docs, over whole texts.

    Null and empty texts hold no word and get the chain's base rates; repeated
    rows and null ids are kept row by row; without labels nothing is toxic.  Other
    columns of docs are not looked at.
    """
    chain = train(spark, docs, labels, "toxic", max_train)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    out = rows.mapInArrow(_score(chain), "doc_id long, " + ", ".join(f"p_{n} double" for n in chain.names))
    return out.withColumn("toxic", (F.col("p_toxic") >= cut).cast("int"))
