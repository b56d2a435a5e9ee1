"""N-gram Jaccard self-join by universe-partition pigeonhole.

A document is the set of hashes of its distinct word n-grams.  For two sets with
Jaccard similarity of at least J = num/den the symmetric difference d obeys
``d <= (|x|+|y|) (den-num)/(den+num)``.  Sizes are cut into bands; for a band the
largest such d is H, and the hash universe is cut into m segments.  A set indexes
its segments' subsets under its own band and, where a smaller partner may live
there, under bands below.

An empty subset would cost most, since every set that misses the segment shares
it; it is never indexed.  Instead a set must have units for H+1: linked sets
differ by one in at most H places, so if a set has H+1 filled segments, one of
these agrees.  A set that has fewer indexes a finer cut of the universe too, until
it has enough.  Of two linked sets the one that stops first has its units at a cut
that both index, so one of its filled segments agrees there.  (Sets that find no
cut, as small ones may below a similarity of 2/3, index a plain cut of H+1 segments
with its empty subsets, by which they meet each other.)

Cost-based allocation: a band's segments are either short, with their subset alone
(one unit each), or about half as many and twice as long, with the subset and all
its one-deletion neighbours (two units where a subset has two members or more).
Long ones cost more rows and meet far less often by chance.  Both are counted over
all documents, in a hash-picked part of the buckets of a segment of each band: rows,
members beyond the first of a bucket, and pairs in buckets; the cheaper one is
taken, band by band.

Equal sets are one class from the start, named by a hash of the set.  In each
bucket the smallest class, the hub, is verified exactly against every other whose
size and odd sketch (a lower bound of the difference) allow a link.  Members of a
hub that are then still in different components are decided in blocks of bounded
size: those near the hub exactly, from their differences to it; those far from it
by their sketches first, and what these allow exactly.  Near and far members cannot
link, by the triangle inequality, and some count as both.  So no pair of a bucket
stays undecided, while copies are never expanded into pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.components import connected_components
from lectern.llm.workspace import Workspace, checked_broadcast, small_batches

_M1, _M2, _P = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
#: Words remembered with their hash by a worker, and the longest that is.
MEMO_WORDS, MEMO_BYTES = 150_000, 64
#: Members of a block, and hashes of a slice, when the members of one hub are compared.
BLOCK, SLICE = 1_024, 2_048
#: Cuts of the universe that a set tries; what a bucket's member beyond the first, and a pair in a bucket, cost in index rows.
CUTS, HUB_COST, PAIR_COST = 6, 20.0, 0.05
#: One in so many buckets of a segment is counted, whole, for the costs.
SAMPLE = 16
_FAR = np.iinfo(np.int64).max


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Memo(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= MEMO_BYTES:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = h
        return h


def shingle_set(text: bytes, n: int, memo: _Memo) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of a UTF-8 text, words as in the contract; fewer than n words: one shingle; none: empty."""
    words = text.lower().split()  # on bytes: A-Z only, and exactly the six ASCII white spaces
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = (out * _P) + h[i : len(h) - k + 1 + i]
    return np.unique(_mix(out))


class Bands:
    """Size bands of a threshold num/den, and the cuts of the universe for each."""

    def __init__(self, num: int, den: int, step: float = 1.25):
        self.num, self.den = num, den
        lo = 1
        while self.most(lo) < 1:
            lo += 1
        self.first, self.hi, self.known = lo, [], {}
        self.step = max(step, den / num)

    def most(self, x: int) -> int:
        """Largest symmetric difference between a set of x and a linked one of at least x members."""
        y = x * self.den // self.num
        return (x + y) * (self.den - self.num) // (self.den + self.num)

    def tags(self, n: int) -> list[int]:
        """Bands that a set of n members indexes under."""
        if n < self.first:
            return []
        while not self.hi or self.hi[-1] < n:
            lo = self.hi[-1] + 1 if self.hi else self.first
            self.hi.append(max(lo, int(lo * self.step)))
        k = next(i for i, h in enumerate(self.hi) if n <= h)
        return [j for j in range(k + 1) if j == k or self.hi[j] * self.den >= n * self.num]

    def cuts(self, band: int, units: int) -> list[int]:
        """Segments of each cut for a band: the first gives most sets of its smallest size units for H+1, up to `units` a segment; the next are finer."""
        if (band, units) not in self.known:
            lo, need = (self.hi[band - 1] + 1 if band else self.first), self.most(self.hi[band]) + 1
            m = np.arange(max(2, need // units), 4 * need + 3)
            rate = lo / m
            mean = m * (units - np.exp(-rate) * (1 if units == 1 else 2 + rate))
            spread = np.sqrt(m * np.exp(-rate) * (units + rate * (units - 1)))
            k = int(np.argmax(mean >= need + 1.5 * spread)) if (mean >= need + 1.5 * spread).any() else 0
            cut = [int(m[k])]
            while len(cut) < CUTS:
                cut.append(cut[-1] + max(1, cut[-1] // 6))
            self.known[band, units] = cut
        return self.known[band, units]

    def salt(self, band: int, cut: int, m: int) -> np.ndarray:
        """cut: its number, CUTS higher for long segments, -1 for the plain cut."""
        if (band, cut, "salt") not in self.known:
            self.known[band, cut, "salt"] = _mix(np.arange(m, dtype=np.uint64) + np.uint64(((band + 1) << 40) + ((cut + 1) << 32)))
        return self.known[band, cut, "salt"]


def _subsets(u: np.ndarray, total: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each of m segments: where its members end (from 0), and their sum."""
    segment = ((u >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)  # rises with u, so a segment is a slice
    at = np.searchsorted(segment, np.arange(m + 1, dtype=np.uint64))
    ends = total[at]
    return at, ends[1:] - ends[:-1]


def _entries(u: np.ndarray, w: np.ndarray, total: np.ndarray, m: int, units: int, salt: np.ndarray) -> tuple[np.ndarray, int]:
    """What a set indexes at one cut, and the units it has there."""
    at, subset = _subsets(u, total, m)
    size = np.diff(at)
    has = size > 0
    out = _mix((subset + salt)[has])
    if units == 1:
        return out, len(out)
    s = np.repeat(np.arange(m), np.where(size > 1, size, 0))
    return np.concatenate([out, _mix(subset[s] - w[np.repeat(size > 1, size)] + salt[s])]), int(np.minimum(size, units).sum())


def _prepared(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = _mix(u + _P)
    return w, np.concatenate([np.zeros(1, np.uint64), np.cumsum(w, dtype=np.uint64)])


def signatures(u: np.ndarray, bands: Bands, long_bands: frozenset[int] = frozenset()) -> np.ndarray:
    """What a sorted set of hashes indexes; see the module's text."""
    tags = bands.tags(len(u))
    if not tags:
        return np.empty(0, np.uint64)
    w, total = _prepared(u)
    out = []
    for band in tags:
        units, need = 1 + (band in long_bands), bands.most(bands.hi[band]) + 1
        for cut, m in enumerate(bands.cuts(band, units)):
            found, has = _entries(u, w, total, m, units, bands.salt(band, cut + (units - 1) * CUTS, m))
            out.append(found)
            if has >= need:
                break
        else:
            out.append(_mix(_subsets(u, total, need)[1] + bands.salt(band, -1, need)))
    return np.concatenate(out)


def _samples(u: np.ndarray, bands: Bands) -> np.ndarray:
    """Entries of one segment of each band's first cut, short and long, as far as their hash is in the sample; the lowest seven bits tell band and kind."""
    out = [np.empty(0, np.uint64)]
    for band in bands.tags(len(u)):
        for units in (1, 2):
            m = bands.cuts(band, units)[0]
            edge = [-(-k * (1 << 32) // m) << 32 for k in (m // 2, m // 2 + 1)]
            part = u[np.searchsorted(u, np.uint64(edge[0])) : np.searchsorted(u, np.uint64(edge[1])) if edge[1] < 1 << 64 else len(u)]
            w = _mix(part + _P)
            whole = w.sum(dtype=np.uint64)
            found = _mix(np.append(whole - w, whole)) if units == 2 and len(w) > 1 else _mix(whole[None]) if len(w) else w
            out.append((found[(found >> np.uint64(7)) % np.uint64(SAMPLE) == 0] & ~np.uint64(127)) | np.uint64(2 * min(band, 63) + units - 1))
    return np.concatenate(out)


def _index(n: int, num: int, den: int):
    """(doc_id, n, fp, cls, sketch, samples): a set's size, print and class, and for the first of a class in a task what is counted and compared."""

    def run(batches):
        memo, bands, seen = _Memo(), Bands(num, den), set()
        for b in batches:
            sizes, prints, keys, marks, samples = [], [], [], [], []
            for key, text in zip(b.column(0), b.column(1)):
                u = shingle_set(text.as_py() or b"", n, memo)
                fp = xxhash.xxh3_128_digest(u.tobytes())
                sizes.append(len(u))
                prints.append(fp)
                keys.append(int.from_bytes(fp[:8], "little", signed=True))
                new = key.is_valid and len(u) > 0 and fp not in seen
                if new:
                    seen.add(fp)
                marks.append(sketch(u, _bits(len(u), bands)).tobytes() if new else None)
                samples.append(_samples(u, bands).view(np.int64) if new else [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(keys, pa.int64()), pa.array(marks, pa.binary()), pa.array(samples, pa.list_(pa.int64()))], ["doc_id", "n", "fp", "cls", "sketch", "samples"])

    return run


def _signed(n: int, num: int, den: int, long_bands: frozenset[int]):
    """(sig, cls) rows; an equal set of the task is passed over."""

    def run(batches):
        memo, bands, seen = _Memo(), Bands(num, den), set()
        for b in batches:
            sigs, keys = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for key, text in zip(b.column(0), b.column(1)):
                u = shingle_set(text.as_py() or b"", n, memo) if key.is_valid else ()
                if len(u) and (fp := xxhash.xxh3_128_digest(u.tobytes())) not in seen:
                    seen.add(fp)
                    sigs.append(signatures(u, bands, long_bands))
                    keys.append(np.full(len(sigs[-1]), int.from_bytes(fp[:8], "little", signed=True)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(keys))], ["sig", "cls"])

    return run


def long_bands(samples: DataFrame, num: int, den: int) -> frozenset[int]:
    """Bands for which long segments with one-deletion neighbours cost less than short ones.  samples: (cls, sample)."""
    kind = F.col("sample").bitwiseAND(F.lit(127))
    bucket = samples.distinct().groupBy("sample").agg(F.count("*").alias("c"))
    cost = F.sum(F.col("c") + HUB_COST * (F.col("c") - 1) + PAIR_COST * F.col("c") * F.col("c"))
    costs = {r.kind: r.cost for r in bucket.groupBy(kind.alias("kind")).agg(cost.alias("cost")).collect()}  # at most 128 rows
    bands, out = Bands(num, den), set()
    for band in {k // 2 for k in costs}:
        while len(bands.hi) <= band:
            bands.tags(bands.hi[-1] + 1 if bands.hi else bands.first)
        short, long = (costs.get(2 * band + k, 0.0) * bands.cuts(band, k + 1)[0] for k in (0, 1))
        if long < short:
            out.add(band)
    return frozenset(out)


def sketch(u: np.ndarray, bits: int) -> np.ndarray:
    """Odd sketch: bit i tells whether an odd number of members falls on i.  The sketches of two sets differ in at most |x xor y| bits; folding halves a sketch."""
    at = ((u * _P) >> np.uint64(40)).astype(np.int64) & (bits - 1)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8))


def fold(s: np.ndarray, size: int) -> np.ndarray:
    while len(s) > size:
        s = s[: len(s) // 2] ^ s[len(s) // 2 :]
    return s


def _bits(n: int, bands: Bands) -> int:
    """Sketch bits of a set of n: enough that unrelated sets differ in more than the threshold allows."""
    return max(256, 1 << (4 * bands.most(n)).bit_length())


def _sets(n: int):
    """(cls, size, fp, x): the set of a class's text; rows of the same id and another text are passed over."""

    def run(batches):
        memo = _Memo()
        for b in batches:
            u = [shingle_set(x.as_py() or b"", n, memo) for x in b.column("text")]
            same = pa.array([xxhash.xxh3_128_digest(x.tobytes()) == f.as_py() for x, f in zip(u, b.column("fp"))], pa.bool_())
            cols = [b.column("cls"), pa.array([len(x) for x in u], pa.int64()), b.column("fp"), pa.array([x.tobytes() for x in u], pa.binary())]
            yield pa.RecordBatch.from_arrays([c.filter(same) for c in cols], ["cls", "size", "fp", "x"])

    return run


def _bounded(num: int, den: int):
    """For pairs with their sketches: whether sizes and the sketches' difference allow a link, and whether they allow b to be near a."""

    def run(batches):
        bands = Bands(num, den)
        for b in batches:
            maybe, near = [], []
            for n, m, x, y in zip(b.column("n").to_pylist(), b.column("m").to_pylist(), b.column("x"), b.column("y")):
                x, y = np.frombuffer(x.as_py(), np.uint8), np.frombuffer(y.as_py(), np.uint8)
                k = min(len(x), len(y))
                low = max(abs(n - m), int(np.bitwise_count(fold(x, k) ^ fold(y, k)).sum()))
                maybe.append(low * (den + num) <= (n + m) * (den - num))
                near.append(low <= _reach(m, bands))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(maybe, pa.bool_()), pa.array(near, pa.bool_())], ["a", "b", "maybe", "near"])

    return run


def _reach(n: int, bands: Bands) -> int:
    """A member of n farther from its hub than this is far: with M its threshold, a partner is more than this less M from the hub."""
    return bands.most(n) + bands.most(n) * 3 // 5


def _edge(n: int, bands: Bands) -> int:
    """A member of n must be farther from its hub than this to link with a far one, whose threshold is at least (M - 2) num / den."""
    return bands.most(n) * 3 * bands.num // (5 * bands.den) - 4


def _linked(num: int, den: int):
    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("x"), b.column("y")):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(keep, pa.bool_())), b.column("b").filter(pa.array(keep, pa.bool_()))], ["a", "b"])

    return run


def _apart(num: int, den: int):
    """Of a member near its hub: the symmetric difference of their sets, and whether far members may link with it."""

    def run(batches):
        bands = Bands(num, den)
        for b in batches:
            out, far = [], []
            for x, y in zip(b.column("x"), b.column("y")):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                d = np.setxor1d(x, y, assume_unique=True)
                out.append(d.tobytes())
                far.append(len(d) > _edge(len(y), bands))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("hub", "cls", "root", "outside", "parts", "size")), pa.array(out, pa.binary()), pa.array(far, pa.bool_())], ["hub", "cls", "root", "outside", "parts", "size", "apart", "far"])

    return run


def _far_blocks(num: int, den: int):
    """Pairs of two blocks of a hub's far members whose sizes and sketches allow a link, from different components."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        l, r = pdf[pdf.side == 0].drop_duplicates("cls"), pdf[pdf.side == 1].drop_duplicates("cls")
        if not len(l) or not len(r):
            return pd.DataFrame({"a": [], "b": []}).astype("int64")
        k = min(len(x) for x in pdf.apart)
        x, y = (np.stack([fold(np.frombuffer(s, np.uint8), k) for s in t.apart]) for t in (l, r))
        apart = np.zeros((len(l), len(r)), np.int32)
        for at in range(0, k, SLICE // 8):  # sketches of long texts are unpacked a slice at a time
            u, v = (np.unpackbits(s[:, at : at + SLICE // 8], axis=1).astype(np.float32) for s in (x, y))
            apart += (u.sum(1)[:, None] + v.sum(1) - 2 * (u @ v.T)).astype(np.int32)
        ls, rs = l["size"].to_numpy(np.int64)[:, None], r["size"].to_numpy(np.int64)
        near = np.maximum(apart, abs(ls - rs)) * (den + num) <= (ls + rs) * (den - num)
        near &= l.root.to_numpy()[:, None] != r.root.to_numpy()
        i, j = np.nonzero(near)
        a, b = l.cls.to_numpy()[i], r.cls.to_numpy()[j]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).astype("int64")

    return run


def _blocks(num: int, den: int):
    """Links between two blocks of a hub's members, as one link into its component for each member that has any.

    With D(x) = x xor hub: |x xor y| = |D(x)| + |D(y)| - 2 |D(x) and D(y)|, and the
    last term, for all pairs of the blocks, is a product of 0/1 matrices over
    slices of the hashes that both blocks hold.
    """

    def table(t: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        d = [np.frombuffer(x, np.uint64) for x in t.apart]
        n = np.array([len(x) for x in d], np.int64)
        return np.repeat(np.arange(len(d)), n), np.concatenate([*d, np.empty(0, np.uint64)]), n, t["size"].to_numpy(np.int64)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        l, r = pdf[pdf.side == 0].drop_duplicates("cls"), pdf[pdf.side == 1].drop_duplicates("cls")
        if not len(l) or not len(r):
            return pd.DataFrame({"a": [], "b": []}).astype("int64")
        lid, rid = l.cls.to_numpy(), r.cls.to_numpy()
        (lr, lt, ln, ls), (rr, rt, rn, rs) = table(l), table(r)
        words = np.intersect1d(lt, rt)
        li, ri = np.isin(lt, words), np.isin(rt, words)
        lr, lt, rr, rt = lr[li], np.searchsorted(words, lt[li]), rr[ri], np.searchsorted(words, rt[ri])
        both = np.zeros((len(lid), len(rid)), np.float32)
        for at in range(0, len(words), SLICE):
            x, y = np.zeros((len(lid), SLICE), np.float32), np.zeros((len(rid), SLICE), np.float32)
            k = (lt >= at) & (lt < at + SLICE)
            x[lr[k], lt[k] - at] = 1
            k = (rt >= at) & (rt < at + SLICE)
            y[rr[k], rt[k] - at] = 1
            both += x @ y.T
        apart = ln[:, None] + rn - 2 * both.astype(np.int64)
        near = apart * (den + num) <= (ls[:, None] + rs) * (den - num)
        near &= l.root.to_numpy()[:, None] != r.root.to_numpy()
        low, top = lid.copy(), rid.copy()
        while near.any():
            a = np.minimum(low, np.where(near, top, _FAR).min(1))
            c = np.minimum(top, np.where(near, a[:, None], _FAR).min(0))
            if (a == low).all() and (c == top).all():
                break
            low, top = a, c
        i, j = near.any(1), near.any(0)
        return pd.DataFrame({"a": np.concatenate([lid[i], rid[j]]), "b": np.concatenate([low[i], top[j]])}).astype("int64")

    return run


def near_duplicates(spark: SparkSession, docs: DataFrame, n: int = 5, num: int = 4, den: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs.

    Documents link at a Jaccard similarity of n-gram sets of num/den or more.
    Null or empty texts: 0 shingles, linked with nothing.  Null ids: linked with
    nothing, component null.  Rows that repeat an id give a row each; the links of
    all their texts are united under that id.  An empty table gives an empty
    result; other columns are not looked at.
    """
    small_batches(spark)
    ws = Workspace(spark, "ngram")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    index = ws.write(rows.mapInArrow(_index(n, num, den), "doc_id long, n long, fp binary, cls long, sketch binary, samples array<long>"), "index")
    member = index.select("doc_id", "n", "cls")
    # partial sums first: copies of one text may be many
    classes = index.where("n > 0 AND doc_id IS NOT NULL").groupBy("cls", "fp").agg(F.min("doc_id").alias("name"), F.max("n").alias("size"), F.max("sketch").alias("sketch"))
    classes = ws.write(classes, "classes")
    long = long_bands(index.select("cls", F.explode("samples").alias("sample")), num, den)

    # rows of a signature come sorted by class, so that the first one seen is the hub and nothing is held back
    signed = rows.mapInArrow(_signed(n, num, den, long), "sig long, cls long")
    hub = F.first("cls").over(W.partitionBy("sig").orderBy("cls").rowsBetween(W.unboundedPreceding, W.currentRow))
    bucket = ws.write(signed.withColumn("hub", hub).where("cls != hub").select("hub", "cls").distinct(), "buckets")  # every member of every bucket, with the bucket's hub

    def texts(ids: DataFrame, tag: str) -> DataFrame:
        """Sets of some classes, from their texts; sets of all documents would be larger than the texts."""
        some = ws.write(ids.toDF("cls").distinct().join(classes.select("cls", "fp", F.col("name").alias("doc_id")), "cls"), "ids")
        held = rows.join(checked_broadcast(some), "doc_id").select("cls", "fp", "text")
        out = ws.write(held.mapInArrow(_sets(n), "cls long, size long, fp binary, x binary").dropDuplicates(["cls", "fp"]).drop("fp"), tag)
        ws.drop(some)
        return out

    def verified(pairs: DataFrame, tag: str) -> DataFrame:
        sets = texts(pairs.select("a").union(pairs.select("b")), "sets")
        x, y = sets.select(F.col("cls").alias("a"), "x"), sets.select(F.col("cls").alias("b"), F.col("x").alias("y"))
        out = ws.write(pairs.join(y, "b").join(x, "a").mapInArrow(_linked(num, den), "a long, b long"), tag)
        ws.drop(sets)
        return out

    # sizes and sketches bound the difference from below; only pairs that they allow move their sets
    drawn = classes.select("cls", "size", F.col("sketch").alias("x"))
    x, y = drawn.select(F.col("cls").alias("a"), F.col("size").alias("n"), "x"), drawn.select(F.col("cls").alias("b"), F.col("size").alias("m"), F.col("x").alias("y"))
    first = ws.write(bucket.toDF("a", "b").join(y, "b").join(x, "a").mapInArrow(_bounded(num, den), "a long, b long, maybe boolean, near boolean"), "pairs")
    ws.drop(bucket)
    links = verified(first.where("maybe").select("a", "b").distinct(), "links")
    roots = ws.write(connected_components(ws, links, "a", "b"), "roots")

    # Left to decide: members of one hub's buckets in different components, by blocks.
    hubbed = first.groupBy(F.col("a").alias("hub"), F.col("b").alias("cls")).agg(F.max("near").alias("near")).join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("hub", "cls", F.coalesce("root", "cls").alias("root"), "near")
    sized = hubbed.groupBy("hub", "root").agg(F.count("*").alias("k")).groupBy("hub").agg(F.max(F.struct("k", "root"))["root"].alias("main"), F.count("*").alias("roots"), F.sum("k").alias("k")).where("roots > 1")
    open_ = ws.write(hubbed.join(sized, "hub").select("hub", "cls", "root", "near", (F.col("root") != F.col("main")).alias("outside"), F.ceil(F.col("k") / BLOCK).cast("int").alias("parts")), "open")
    ws.drop(first)
    if not open_.isEmpty():
        keys = ["hub", "cls", "root", "outside", "parts", "size"]

        def blocks(t: DataFrame, compare, tag: str) -> DataFrame:
            t = t.withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
            every = F.sequence(F.lit(0), F.col("parts") - 1)
            left = t.where("outside").withColumn("j", F.explode(every)).select("hub", F.col("part").alias("i"), "j", F.lit(0).alias("side"), "cls", "root", "size", "apart")
            right = t.withColumn("i", F.explode(every)).select("hub", "i", F.col("part").alias("j"), F.lit(1).alias("side"), "cls", "root", "size", "apart")
            return ws.write(left.unionByName(right).groupBy("hub", "i", "j").applyInPandas(compare, "a long, b long"), tag)

        close = open_.where("near")
        sets = texts(close.select("cls").union(close.select("hub")), "near_sets")
        x, y = sets.select(F.col("cls").alias("hub"), "x"), sets.select("cls", "size", F.col("x").alias("y"))
        apart = ws.write(close.join(y, "cls").join(x, "hub").select(*keys, "x", "y").mapInArrow(_apart(num, den), "hub long, cls long, root long, outside boolean, parts int, size long, apart binary, far boolean"), "apart")
        ws.drop(sets)
        more = blocks(apart, _blocks(num, den), "more")
        marks = drawn.withColumnRenamed("x", "apart")
        far = open_.where("NOT near").join(marks, "cls").select(*keys, "apart").unionByName(apart.where("far").drop("apart", "far", "size").join(marks, "cls").select(*keys, "apart"))
        rest = ws.write(blocks(far, _far_blocks(num, den), "rest").distinct(), "rest")
        ws.drop(apart)
        for found in (more, verified(rest, "rest_links")):
            links = links.unionByName(found)
        if not more.isEmpty() or not rest.isEmpty():
            roots = ws.write(connected_components(ws, links, "a", "b"), "roots")
    rooted = classes.select("cls", "name").join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "name", F.coalesce("root", "cls").alias("root"))
    least = rooted.groupBy("root").agg(F.min("name").alias("component"))
    named = ws.write(rooted.join(least, "root").groupBy("cls").agg(F.min("component").alias("component")), "named")
    # an id with several texts holds their components together
    several = ws.write(member.where("n > 0").groupBy("doc_id").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo != hi AND doc_id IS NOT NULL").select("doc_id"), "several")
    if not several.isEmpty():
        held = ws.write(member.where("n > 0").join(several, "doc_id").join(named, "cls").select("doc_id", "component").distinct(), "held")
        joined = connected_components(ws, held, "doc_id", "component").withColumnRenamed("node", "component")
        named = ws.write(named.join(joined, "component", "left").select("cls", F.coalesce("root", "component").alias("component")), "named")
    ws.drop_all_but(index, named)
    found = member.join(named, "cls", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNull() | (F.col("n") == 0), F.col("doc_id")).otherwise(F.coalesce("component", "doc_id")).alias("component_id"))
