"""Languages of a text as a mixture: expectation-maximisation over n-gram likelihoods.

A text is a bag of letter trigrams (code points, lower-cased; whatever is no letter
is one space), hashed to a fixed number of bins.  Each learned language gives a bin
a likelihood.  A text's language proportions maximise the likelihood of a mixture of
these; expectation-maximisation finds them for a given set of languages.  The set
is grown from the single best language by the one that the likelihood's slope
favours most, for as long as the likelihood rises by more than the penalty of
another language; the concave likelihood bounds what any further language could
bring, so most texts need no iteration at all.

Likelihoods are counted from a bounded number of labelled texts of each language,
picked by a hash of their id; ids whose crc32 leaves remainder 0 by 5 are never
learned from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.workspace import Workspace, checked_broadcast, small_batches

#: Labelled texts of a language to learn from at most, and most languages (those with most texts); bins; smoothing of a bin.
MAX_TEXTS, LANGUAGES, BINS, SMOOTH = 4_000, 64, 1 << 15, 0.5
#: Trigrams overlap, so each letter tells three times: the penalty of a language is half of the logarithm of the count, times this.
OVERLAP = 3.0
#: Steps of expectation-maximisation at most, and the rise of the likelihood at which they end.
STEPS, RISE = 60, 1e-3
#: Buckets of ids by which the learned texts are picked.
BUCKETS = 1024
UNKNOWN = "und"
_ASCII = np.array([ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(128)], np.uint32)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Bins of a whole text's trigrams, rising, and their counts; a text without a letter has none."""
    raw = text.lower()
    c = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), np.uint32)
    wide = c >= 128
    if wide.any():
        known = {x: x if chr(x).isalpha() else 32 for x in np.unique(c[wide]).tolist()}
        keys = np.fromiter(known, np.uint32)
        c = np.where(wide, np.fromiter(known.values(), np.uint32)[np.searchsorted(keys, c).clip(max=len(keys) - 1)], _ASCII[np.minimum(c, 127)])
    else:
        c = _ASCII[c]
    c = np.concatenate([[32], c, [32]]).astype(np.uint64)
    c = c[np.append((c[1:] != 32) | (c[:-1] != 32), True)]
    if len(c) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    h = (c[:-2] * np.uint64(0x9E3779B1) + c[1:-1] * np.uint64(0x85EBCA77) + c[2:] * np.uint64(0xC2B2AE3D)) & np.uint64(0xFFFFFFFF)
    n = np.bincount(((h ^ (h >> np.uint64(15))) % np.uint64(BINS)).astype(np.int64), minlength=BINS)
    at = np.flatnonzero(n)
    return at, n[at]


class Mixture:
    """Languages in the order of their names, and the logarithm of each bin's likelihood in each (bins, languages)."""

    def __init__(self, names: list[str], counts: np.ndarray):
        self.names = names
        self.logs = np.log((counts + SMOOTH) / (counts.sum(0) + SMOOTH * BINS)).astype(np.float32)

    def infer(self, text: str) -> tuple[list[int], np.ndarray]:
        """The languages of a text with a letter, the largest share first, and their shares."""
        at, n = trigrams(text)
        logs = self.logs[at].astype(np.float64)
        total, n = n.sum(), n.astype(np.float64)
        own = n @ logs
        held = [int(own.argmax())]
        shares, value = np.ones(1), float(own[held[0]])
        p = None
        penalty = OVERLAP * 0.5 * np.log(max(total, 2))
        while len(held) < len(self.names):
            if p is None:
                top = logs.max(1)
                value -= float(n @ top)
                p = np.exp(logs - top[:, None])  # each bin's likelihoods, by its largest
            slope = (n / np.maximum(p[:, held] @ shares, 1e-300)) @ p
            slope[held] = 0
            new = int(slope.argmax())
            # the likelihood is concave in the shares: no mixture rises above the slope's excess
            if slope[new] - total <= penalty:
                break
            more = [*held, new]
            new_shares, new_value = self._fit(p[:, more], n, np.append(shares * 0.9, 0.1))
            if new_value - value <= penalty:
                break
            held, shares, value = more, new_shares, new_value
        order = np.lexsort((held, -shares))
        return [held[i] for i in order], shares[order]

    @staticmethod
    def _fit(p: np.ndarray, n: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, float]:
        """Shares that maximise n . log(p @ shares), and that value."""
        total, before = n.sum(), -np.inf
        for _ in range(STEPS):
            mixed = np.maximum(p @ shares, 1e-300)
            value = float(n @ np.log(mixed))
            if value - before < RISE:
                break
            before, shares = value, shares * ((n / mixed) @ p) / total
        return shares, float(n @ np.log(np.maximum(p @ shares, 1e-300)))


def held_out(doc_id: Column) -> Column:
    """True for ids whose crc32, of the id as text, leaves remainder 0 by 5; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(ws: Workspace, docs: DataFrame, max_texts: int = MAX_TEXTS, languages: int = LANGUAGES) -> DataFrame:
    """(lang, text): of each of the most common languages, the texts of the first buckets of ids that hold at most max_texts (its first bucket always)."""
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int")
    may = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).withColumn("bucket", bucket)
    sizes = ws.write(may.groupBy("lang", "bucket").agg(F.count("*").alias("n")), "sizes")
    common = F.broadcast(sizes.groupBy("lang").agg(F.sum("n").alias("texts")).orderBy(F.col("texts").desc(), "lang").limit(languages).select("lang"))  # at most `languages` rows
    own = W.partitionBy("lang").orderBy("bucket")  # at most BUCKETS rows a language
    picked = sizes.join(common, "lang").withColumns({"upto": F.sum("n").over(own), "i": F.row_number().over(own)}).where(F.col("upto").between(1, max_texts) | (F.col("i") == 1)).select("lang", "bucket")
    return may.join(checked_broadcast(picked, languages * BUCKETS), ["lang", "bucket"]).select("lang", "text")


def _count(batches):
    held: dict[str, np.ndarray] = {}
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
            at, n = trigrams(text)
            if len(at):
                held.setdefault(lang, np.zeros(BINS, np.int64))[at] += n
    for lang, n in held.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at)), "bin": pa.array(at.astype(np.int32)), "n": pa.array(n[at])})


def train(spark: SparkSession, docs: DataFrame, max_texts: int = MAX_TEXTS, languages: int = LANGUAGES) -> Mixture:
    """Bin counts of the sampled texts by language: at most languages * BINS rows reach the driver."""
    small_batches(spark)
    ws = Workspace(spark, "language")
    counted = sample(ws, docs, max_texts, languages).mapInArrow(_count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    rows = counted.groupBy("lang").agg(F.collect_list("bin").alias("bins"), F.collect_list("n").alias("ns")).orderBy("lang").collect()
    ws.drop_all_but()
    counts = np.zeros((BINS, len(rows)))
    for i, r in enumerate(rows):
        counts[r.bins, i] = r.ns
    return Mixture([r.lang for r in rows], counts)


def _infer(model: Mixture):
    def run(batches):
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                if text is None or not model.names or not has_letter(text):
                    out.append((UNKNOWN, 0.0, [], []))
                    continue
                held, shares = model.infer(text)
                shares = np.minimum(shares, 1.0).tolist()
                out.append((model.names[held[0]], shares[0], [model.names[i] for i in held], shares))
            told = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(told[0], pa.string()), pa.array(told[1], pa.float64()), pa.array(told[2], pa.list_(pa.string())), pa.array(told[3], pa.list_(pa.float64()))], ["doc_id", "lang_pred", "score", "languages", "shares"])

    return run


def identify(spark: SparkSession, docs: DataFrame, max_texts: int = MAX_TEXTS, languages: int = LANGUAGES) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, languages, shares) for every row of docs.

    languages and shares are the text's mixture, the largest share first (equal ones
    by name); lang_pred and score are its first entries.  A null text, one without a
    letter (so an empty one), and every text if nothing was learned, is `und` with
    score 0 and no languages.  Whole texts are read, however long; repeated rows and
    null ids are kept row by row.  Texts of several languages under one id all
    count.  Needs the columns doc_id, text and lang; others are not looked at.
    """
    model = train(spark, docs, max_texts, languages)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(_infer(model), "doc_id long, lang_pred string, score double, languages array<string>, shares array<double>")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "languages", "shares")
