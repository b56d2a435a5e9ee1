"""Shared working tables and small helpers of the corpus operators.

Intermediate results that cut lineage are Parquet tables in the folder that the
session names in ``spark.checkpoint.dir``: executors can be lost at any time and
the table is still there.  Only where the setting is absent and the master is local
(tests, a laptop) a temporary folder is made and set; a cluster must name one.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch handed to Python; bounds a worker's memory on very long texts.
ARROW_ROWS, ARROW_BYTES = 512, 32 << 20
#: A side of at most so many rows, and bytes where it is a working table, may be broadcast, after counting.
BROADCAST_ROWS, BROADCAST_BYTES = 300_000, 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and, where this Spark knows the setting, by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


class Workspace:
    """Working tables of one call."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/lectern-{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        self.tables: list[DataFrame] = []

    def path(self, tag: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{tag}"

    def write(self, df: DataFrame, tag: str, **options: str) -> DataFrame:
        """The same rows, read back from a table of their own; options of the Parquet writer."""
        path = self.path(tag)
        df.write.options(compression="zstd", **options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._lectern_path = path
        self.tables.append(out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for t in tables:
            if path := getattr(t, "_lectern_path", None):
                jvm = self.spark._jvm
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


    def drop_all_but(self, *kept: DataFrame) -> None:
        """Delete this call's tables that its result does not read."""
        paths = {t._lectern_path for t in kept}
        self.drop(*(t for t in self.tables if t._lectern_path not in paths))
        self.tables = list(kept)


def checked_broadcast(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Hint a broadcast only when counted rows and, of a working table, stored bytes are within the bounds; else Spark shuffles."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS and stored_bytes(df) <= BROADCAST_BYTES else df


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the working table that df is; 0 for other frames, which are narrow wherever they are checked."""
    if not (path := getattr(df, "_lectern_path", None)):
        return 0
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """The wanted names, each with underscores before it until no taken one equals it (letter case aside)."""
    known, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in known:
            name = "_" + name
        known.add(name.lower())
        out.append(name)
    return out


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
