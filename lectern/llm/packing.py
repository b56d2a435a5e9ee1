"""Packing documents into fixed-length token sequences along a space-filling curve.

One pass tokenizes.  Whole windows of a document are sequences of their own and
close at once; what is left of it (less than a window) is kept with a Hilbert
key: token ids are hashed into a count vector, projected on a few fixed random
directions, quantised, and put on the curve.  A range partitioning by that key
(then id, so that copies of one text spread) sorts the leftovers, and each task
fills windows with neighbours, cutting where a window ends.  A task's last,
partly filled window is re-cut into sequences whose lengths are powers of two,
which need no padding.
"""

from __future__ import annotations

import base64
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.workspace import Workspace, small_batches

#: Count-vector buckets, projected dimensions, bits a dimension.
BUCKETS, DIMS, BITS = 256, 4, 15
SPECIAL = "<|endoftext|>"
#: Runs without white space beyond this go to the library whose merges stay fast on them.
LONG_RUN = 4_000


@lru_cache(maxsize=2)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _ranks(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, tokenizer: str, ranks: str | None) -> np.ndarray:
    """Ids as the tokenizers library gives them with add_special_tokens=False.

    With ranks (a file of the same vocabulary) the faster library encodes all but
    texts that name the special token or hold a very long run of one word.
    """
    if ranks and SPECIAL not in text and (len(text) < LONG_RUN or not _long_run(text)):
        return np.asarray(_ranks(ranks).encode_to_numpy(text), np.uint32)
    return np.asarray(_library(tokenizer).encode(text, add_special_tokens=False).ids, np.uint32)


def _long_run(text: str) -> bool:
    return max(map(len, text.split()), default=0) >= LONG_RUN or any(c * LONG_RUN in text for c in " \n\t")


@lru_cache(maxsize=1)
def _directions() -> np.ndarray:
    return np.random.RandomState(20).normal(size=(BUCKETS, DIMS))


def hilbert_keys(x: np.ndarray) -> np.ndarray:
    """Hilbert index of each row of x (n, DIMS), integers below 2**BITS; transposition by Skilling's method."""
    x = x.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (BITS - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[:, i] & q) != 0
            t = np.where(on, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] = np.where(on, x[:, 0] ^ p, x[:, 0] ^ t)
            x[:, i] ^= t
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    q = 1 << (BITS - 1)
    while q > 1:
        t = np.where((x[:, n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(BITS - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def curve_keys(ids: list[np.ndarray]) -> np.ndarray:
    if not ids:
        return np.empty(0, np.int64)
    v = np.stack([np.sqrt(np.bincount(i % BUCKETS, minlength=BUCKETS)) for i in ids])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    u = 0.5 + 0.5 * np.tanh(v @ _directions())
    return hilbert_keys(np.minimum((u * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


def _tokenize(tokenizer: str, ranks: str | None, window: int, end: int):
    def run(batches):
        at = (TaskContext.get().partitionId() << 32) - 1
        for b in batches:
            out = {k: [] for k in ("tokens", "crcs", "first", "rest")}
            docs = []
            for text in b.column("text"):
                ids = np.append(encode(text.as_py() or "", tokenizer, ranks), np.uint32(end))
                docs.append(ids)
                full = len(ids) // window
                out["tokens"].append(len(ids))
                out["crcs"].append([_crc(ids[i * window : (i + 1) * window]) for i in range(full)])
                out["first"].append(2 * (at + 1) + 1)
                at += full
                out["rest"].append(ids[full * window :].astype("<u2" if ids.max() < 65536 else "<u4").tobytes())
            wide = [len(r) // max(1, t % window) for r, t in zip(out["rest"], out["tokens"])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out["tokens"], pa.int64()), pa.array(out["crcs"], pa.list_(pa.int64())), pa.array(out["first"], pa.int64()), pa.array(curve_keys(docs), pa.int64()), pa.array(wide, pa.int32()), pa.array(out["rest"], pa.binary())], ["doc_id", "doc_tokens", "crcs", "first", "curve", "wide", "rest"])

    return run


_PIECE = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def _fill(window: int):
    def run(batches):
        sequence = TaskContext.get().partitionId() << 32
        open_, used = [], 0  # of the open window: (doc, start, ids, doc's tokens)

        def close(pieces, number):
            at = 0
            for doc, start, ids, n in pieces:
                yield (doc, start, len(ids), _crc(ids), n, 2 * number, at)
                at += len(ids)

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * len(_PIECE))], list(_PIECE))

        for b in batches:
            rows = []
            for doc, n, wide, rest in zip(b.column("doc_id").to_pylist(), b.column("doc_tokens").to_pylist(), b.column("wide").to_pylist(), b.column("rest")):
                ids = np.frombuffer(rest.as_py(), "<u2" if wide == 2 else "<u4")
                start = n - len(ids)
                while len(ids):
                    take = min(len(ids), window - used)
                    open_.append((doc, start, ids[:take], n))
                    used, start, ids = used + take, start + take, ids[take:]
                    if used == window:
                        rows += close(open_, sequence)
                        sequence, open_, used = sequence + 1, [], 0
            yield batch(rows)
        rows, size = [], 1 << max(0, used.bit_length() - 1)
        while open_:
            while size > used:
                size >>= 1
            part, room = [], size
            while room:
                doc, start, ids, n = open_[0]
                part.append((doc, start, ids[:room], n))
                took = len(ids[:room])
                room -= took
                open_[0] = (doc, start + took, ids[took:], n)
                if not len(open_[0][2]):
                    open_.pop(0)
            rows += close(part, sequence)
            sequence, used = sequence + 1, used - size
        yield batch(rows)

    return run


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, ranks: str | None = None, window: int = 2048, end: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all documents.

    tokenizer: file of the tokenizers library; ranks: the same vocabulary's rank
    file, or None.  end closes each document.  A null text counts as empty and
    gives one piece, the end id.  Rows that repeat an id are packed each for
    itself; null ids are kept as null.  No documents: no pieces.
    """
    small_batches(spark)
    ws = Workspace(spark, "pack")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    done = ws.write(rows.mapInArrow(_tokenize(tokenizer, ranks, window, end), "doc_id long, doc_tokens long, crcs array<long>, first long, curve long, wide int, rest binary"), "tokens")
    whole = done.where(F.size("crcs") > 0).select("doc_id", "doc_tokens", "first", F.posexplode("crcs").alias("i", "ids_crc32")).select("doc_id", (F.col("i") * F.lit(window)).cast("long").alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.col("first") + 2 * F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = done.where(F.length("rest") > 0).select("curve", "doc_id", "doc_tokens", "wide", "rest")
    rest = rest.repartitionByRange("curve", "doc_id").sortWithinPartitions("curve", "doc_id")
    filled = rest.select("doc_id", "doc_tokens", "wide", "rest").mapInArrow(_fill(window), ", ".join(f"{c} long" for c in _PIECE))
    return whole.unionByName(filled)
