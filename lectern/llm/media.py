"""Content-addressed media payloads in tar shards.

A task writes the payloads of its rows into one tar shard, each content once (by
digest), as a losslessly compressed 8-bit grey image; rows carry digest, shard,
offset and length.  Shards never meet in a shuffle: only these narrow rows do.
A second pass sorts them by place, reads image headers by range for the metadata
columns, then the stored bytes, and derives the features, once for each place.

Shards are written in the shared folder through a file system found from its
URI.  Their names hold the attempt's number, and rows name the shard of the
attempt that succeeded, so a task that is run again leaves at most an unused file.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.workspace import Workspace, small_batches

#: Bytes of an image row; payloads are padded to a positive multiple.
WIDTH, PAD = 576, b"\xff"
HEADER = 33
#: Stored bytes that a task reads back.
TASK_BYTES = 64 << 20
_SIGN = b"\x89PNG\r\n\x1a\n"


def payload_of(text: bytes) -> bytes:
    return text + PAD * ((-len(text)) % WIDTH or (0 if text else WIDTH))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_image(payload: bytes, level: int = 2) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    return _SIGN + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def header_of(start: bytes) -> tuple[int, int, int]:
    """(width, height, bit depth) from an image's first HEADER bytes."""
    if start[:8] != _SIGN or start[12:16] != b"IHDR":
        raise ValueError("not an image of this store")
    return struct.unpack(">IIB", start[16:25])


def from_image(data: bytes) -> bytes:
    width, height, _ = header_of(data)
    at, body = 8, []
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            body.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows are not of this store")
    return lines[:, 1:].tobytes()


def feature_of(payload: bytes, width: int, height: int) -> str:
    """Size, mean sample and a 64-bit average hash over 64 equal stretches."""
    x = np.frombuffer(payload, np.uint8)
    cut = np.linspace(0, len(x), 65).astype(np.int64)
    part = np.add.reduceat(x.astype(np.int64), cut[:-1]) * len(x)
    bits = part > int(x.sum(dtype=np.int64)) * np.diff(cut)
    return f"{width}x{height};mean={int(x.sum(dtype=np.int64)) * 1000 // len(x)};ahash={int(''.join('01'[int(b)] for b in bits), 2):016x}"


def _store(folder: str):
    def run(batches):
        files, base = pafs.FileSystem.from_uri(folder)
        ctx = TaskContext.get()
        shard, out, at, seen = f"shard-{ctx.partitionId():06d}-{ctx.taskAttemptId()}.tar", None, 0, {}
        for b in batches:
            rows = []
            for text in b.column("text"):
                text = text.as_py() or b""
                payload = payload_of(text)
                digest = hashlib.sha256(payload).digest()
                if digest not in seen:
                    if out is None:
                        files.create_dir(base, recursive=True)
                        out = files.open_output_stream(f"{base}/{shard}")
                    data = to_image(payload)
                    info = tarfile.TarInfo(f"{digest.hex()}.png")
                    info.size = len(data)
                    head = info.tobuf(tarfile.USTAR_FORMAT)
                    out.write(head)
                    out.write(data)
                    out.write(b"\0" * (-len(data) % 512))
                    seen[digest] = (at + len(head), len(data))
                    at += len(head) + len(data) + (-len(data) % 512)
                rows.append((len(text), digest, shard, *seen[digest]))
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64())))], ["doc_id", "n_bytes", "digest", "shard", "at", "size"])
        if out is not None:
            out.write(b"\0" * 1024)
            out.close()

    return run


_OUT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int, shard string, shard_offset long"


def _inspect(folder: str):
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in _OUT.split(", ")])

    def run(batches):
        files, base = pafs.FileSystem.from_uri(folder)
        shard, f, place, known = None, None, None, None
        for b in batches:
            rows = []
            for doc, n, digest, s, at, size in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n_bytes", "digest", "shard", "at", "size"))):
                if s != shard:
                    if f is not None:
                        f.close()
                    shard, f = s, files.open_input_file(f"{base}/{s}")
                if (s, at) != place:
                    width, height, _ = header_of(f.read_at(HEADER, at))
                    data = f.read_at(size, at)
                    payload = from_image(data)
                    if hashlib.sha256(payload).digest() != digest:
                        raise ValueError(f"{s} at {at}: the stored bytes are not what their digest says")
                    place = (s, at)
                    known = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature_of(payload, width, height), width, height)
                rows.append((doc, n, *known, s, at))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * len(schema), schema.types)], schema=schema)
        if f is not None:
            f.close()

    return run


def store_media(spark: SparkSession, docs: DataFrame, ws: Workspace, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, str]:
    """(doc_id, n_bytes, digest, shard, at, size) of every row, and the shards' folder."""
    small_batches(spark)
    folder = ws.path("shards")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return ws.write(rows.mapInArrow(_store(folder), "doc_id long, n_bytes long, digest binary, shard string, at long, size long"), "places"), folder


def media_columns(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Metadata and features of every row's stored payload.

    A null text counts as empty (one row of padding).  Equal texts give equal
    values, wherever they are stored; repeated rows and null ids are kept row by
    row.  No rows: no shards and an empty result.
    """
    places, folder = store_media(spark, docs, Workspace(spark, "media"), doc_id, text)
    # rows are narrow, what they point at is not: tasks are counted by stored bytes
    tasks = max(spark.sparkContext.defaultParallelism, (places.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] or 0) // TASK_BYTES + 1)
    near = places.repartitionByRange(tasks, "shard", "at", "doc_id").sortWithinPartitions("shard", "at", "doc_id")
    return near.mapInArrow(_inspect(folder), _OUT)
