"""Files of any size on the workers: opened where they lie and read by blocks or windows, never held as one row."""

from __future__ import annotations

import hashlib
import re
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Bytes read at once where a whole file passes.
BLOCK = 8 << 20


def opened(path: str) -> BinaryIO:
    """A seekable reader of a path as Spark lists it: a local file, or a URI that pyarrow.fs opens (hdfs, s3, gs)."""
    if ":" not in path.split("/")[0] or path.startswith("file:"):
        return open(re.sub("^file:(//)?(?=/)", "", path), "rb")
    store, at = fs.FileSystem.from_uri(quote(re.sub("^s3[an]:", "s3:", path), safe="/:@"))
    return store.open_input_file(at)


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, modificationTime) of all files below root, without their content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")


def digest(path: str) -> str:
    """SHA-256 of a file's bytes, in lower-case hex."""
    out = hashlib.sha256()
    with opened(path) as f:
        while block := f.read(BLOCK):
            out.update(block)
    return out.hexdigest()


def digests(files: DataFrame, path: str = "path", name: str = "id") -> DataFrame:
    """files, streamed or not, with the SHA-256 of each one's bytes as column `name`; a null path gives null, a path that is gone is an error."""

    def run(batches):
        for b in batches:
            found = [None if p is None else digest(p) for p in b.column(path).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], [*b.schema.names, name])

    return files.mapInArrow(run, T.StructType([*files.schema.fields, T.StructField(name, T.StringType())]))
