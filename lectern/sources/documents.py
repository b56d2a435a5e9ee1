"""Readers.  Documents are multi-line JSON files <stage>/<partition>/<video_id>.json; schemas are fixed, nothing is inferred.

Ingest once to the store (Parquet, partitioned by `partition`) and query that:
JSON has no column pruning or pushed filters.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.sources import files

#: Document schemas by stage, file suffixes of videos.
SCHEMAS = {
    "asr_raw": "id string, title string, video string, duration_ms long, processed_at string, asr struct<requested_provider:string,actual_provider:string,model_path:string,model_revision:string,timestamp_method:string,used_vad:boolean,used_punctuation:boolean,hotwords_applied:array<string>,timings_ms:map<string,long>,warnings:array<string>,language:string>, sentences array<struct<id:long,start_ms:long,end_ms:long,raw_text:string>>",
    "cleaned_asr": "source_id string, title string, cleanup string, full_text string, sentences array<struct<sentence_id:long,start_ms:long,end_ms:long,text:string>>",
    "semantic_segments": "video_id string, title string, video_path string, review_status string, revision long, updated_at string, confirmed_at string, segments array<struct<segment_no:long,title:string,summary:string,keywords:array<string>,start_sentence_id:long,end_sentence_id:long,start_ms:long,end_ms:long,content:string,manual_content_override:boolean,edited_at:string>>",
    "history": "source_id string, title string, model string, status string, counts map<string,long>, decisions map<string,long>, completed_at string, updated_at string, warnings array<struct<kind:string,sentence_ids:array<long>,reason:string>>, changes array<struct<sentence_id:long,raw_text:string,proposed_text:string,effective_text:string,status:string,review_reason:string,decision:string,approved_text:string,decided_at:string,glossary_review_pending:boolean,glossary_reviewed_at:string,edits:array<struct<operation:string,before:string,after:string>>>>",
    "business": "title string, annotations array<string>",
    "upload": "id string, filename string, path string, size long, uploaded_at string",
    "jobs": "id string, stage string, status string, created_at string, started_at string, finished_at string, progress long, cancellation_requested boolean, items array<struct<video_id:string,status:string,log:string,current_stage:string,progress_detail:string,progress:long>>",
}
GLOSSARY = "global map<string,array<string>>, sources map<string,map<string,array<string>>>"
SUFFIXES = ("mp4", "mov", "mkv", "avi", "m4v", "webm")
#: The array of each document that becomes a child table.
CHILD = {"asr_raw": "sentences", "cleaned_asr": "sentences", "semantic_segments": "segments", "history": "changes", "jobs": "items"}


def documents(spark: SparkSession, root: str, stage: str) -> DataFrame:
    """SRC1-SRC4: documents of a stage with file_id and partition by path, in path order of reading.

    Files whose name is no id (a manifest, say) are left out; a file that is no
    JSON object gives a row whose fields are null and whose _corrupt_record tells it.
    """
    df = spark.read.schema(SCHEMAS[stage] + ", _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(f"{root}/{stage}")
    path = F.col("_metadata.file_path")
    df = df.withColumns({"file_path": path, "file_id": F.regexp_extract(path, r"([^/]+)\.json$", 1), "partition": F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)})
    return df.where(X.valid_id(F.col("file_id")))


def selected(docs: DataFrame, video_id: str | None = None, limit: int | None = None) -> DataFrame:
    """SRC4, S3, S5: one id, or the first in path order; asking for an absent id is an error."""
    if video_id is not None:
        docs = docs.where(F.col("file_id") == video_id)
        if docs.isEmpty():
            raise FileNotFoundError(video_id)
    return docs.orderBy("file_path").limit(max(0, limit)) if limit is not None else docs


def children(docs: DataFrame, stage: str) -> DataFrame:
    """The child rows of a stage's documents: partition, video_id, pos (from 1) and the struct's fields."""
    return docs.select("partition", F.col("file_id").alias("video_id"), F.posexplode(CHILD[stage]).alias("p", "r")).select("partition", "video_id", (F.col("p") + 1).cast("long").alias("pos"), "r.*")


def nested(rows: DataFrame, order: str, name: str) -> DataFrame:
    """Back from child rows to one row a document with the ordered array."""
    fields = [c for c in rows.columns if c not in ("partition", "video_id", "pos")]
    return rows.groupBy("partition", "video_id").agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*fields).alias("r")))), lambda s: s["r"]).alias(name))


def video_files(spark: SparkSession, root: str) -> DataFrame:
    """SRC5, S3: (path, size) of video files below root, without reading them."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("size"))
    return found.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*SUFFIXES)).orderBy("path")


def uploads(spark: SparkSession, root: str) -> DataFrame:
    """SRC9, SRC10: uploaded files of any size as a manifest by content hash; the same content under the same name counts once."""
    df = files.digests(files.listed(spark, root))
    return df.select("id", X.safe_filename(F.col("path")).alias("filename"), "path", F.col("length").alias("size"), F.col("modificationTime").cast("string").alias("uploaded_at")).dropDuplicates(["id", "filename"])


def upload_stream(spark: SparkSession, root: str) -> DataFrame:
    """ST9: the same as a stream."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    df = spark.readStream.schema(schema).format("binaryFile").option("recursiveFileLookup", True).load(root)
    df = files.digests(df.select("path", "length", "modificationTime"))
    return df.select("id", X.safe_filename(F.col("path")).alias("filename"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("uploaded_at")).withWatermark("uploaded_at", "1 day").dropDuplicatesWithinWatermark(["id", "filename"])


def glossary(spark: SparkSession, path: str) -> DataFrame:
    """SRC14: (scope, video_id, term, aliases) of a glossary file; an absent file is an empty glossary."""
    empty = "scope string, video_id string, term string, aliases array<string>"
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm):
        return spark.createDataFrame([], empty)
    g = spark.read.schema(GLOSSARY).option("multiLine", True).option("mode", "FAILFAST").json(path)
    shared = g.select(F.lit("global").alias("scope"), F.lit(None).cast("string").alias("video_id"), F.explode("global").alias("term", "aliases"))
    own = g.select(F.explode("sources").alias("video_id", "m")).select(F.lit("video").alias("scope"), "video_id", F.explode("m").alias("term", "aliases"))
    return shared.unionByName(own)


def output_rows(timed: DataFrame) -> DataFrame:
    """Rows of a recogniser (video_id, id, start, end, text) as raw sentences."""
    return timed.select("video_id", F.col("id").cast("long").alias("id"), F.col("start").cast("long").alias("start_ms"), F.col("end").cast("long").alias("end_ms"), F.col("text").cast("string").alias("raw_text"))


def stored_name(title: Column, video_id: Column, filename: Column) -> Column:
    """SNK8: the name of a stored video: title, 16 digits of its content's hash, and the lower-cased suffix."""
    return F.concat(title, F.lit("__"), F.left(video_id, F.lit(16)), F.lower(F.regexp_extract(filename, r"(\.[^./\\]+)$", 1)))


def stored_name_clashes(uploads: DataFrame) -> DataFrame:
    """SNK8: (stored_name, contents) of names that would hold several contents; uploads: id, filename."""
    named = uploads.select("id", stored_name(X.upload_title(F.col("filename")), F.col("id"), F.col("filename")).alias("stored_name"))
    return named.groupBy("stored_name").agg(F.count_distinct("id").alias("contents")).where("contents > 1")


def model_value(value):
    """A model's output as JSON can hold it: keys and unknown values as text, arrays as lists."""
    if value is None or isinstance(value, (str, int, float, bool)):
        return value
    if isinstance(value, Mapping):
        return {str(k): model_value(v) for k, v in value.items()}
    if hasattr(value, "tolist"):
        value = value.tolist()
        return [model_value(v) for v in value] if isinstance(value, list) else model_value(value)
    return [model_value(v) for v in value] if isinstance(value, (list, tuple)) else str(value)
