"""The registered queries of the corpus operators, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import centroids, hard_negatives, language, line_dedup, mixing, quality, revisits, toxicity, url_filter
from lectern.llm.media import media_columns
from lectern.llm.ngram_join import near_duplicates
from lectern.llm.packing import pack
from lectern.llm.range_join import range_join
from lectern.llm.workspace import read


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their recurring lines."""
    out = line_dedup.dedup_lines(spark, read(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain's probabilities and verdict for all documents."""
    return toxicity.judge_toxicity(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their probability and whether they are drawn."""
    out = mixing.mix(spark, read(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "lang", F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"), F.round("_p", 6).alias("probability"), F.col("_kept").alias("kept"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page's url."""
    return url_filter.filter_urls(read(spark, sf_dir, "pages"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: three-word shingles, linked from 90 of 100 on."""
    return near_duplicates(spark, read(spark, sf_dir, "documents"), n=3, num=9, den=10)


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All captures derived from the pages, revisits resolved."""
    out = revisits.resolve(spark, revisits.records_of(read(spark, sf_dir, "pages")))
    return out.select("record_id", "canon", "kind", "state", "refers_to", revisits.headers_text(F.col("headers")).alias("headers"), "digest")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for all documents."""
    return quality.judge_quality(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), cut=0.7)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens, each closed by id 1."""
    return pack(spark, read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), window=2048, end=1)


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as stored media, read back; the address of a payload is left out, as it differs for equal texts of two shards."""
    return media_columns(spark, read(spark, sf_dir, "documents")).drop("shard", "shard_offset")


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors, linked within a label from cosine 0.98 on."""
    return range_join(spark, read(spark, sf_dir, "embeddings"), cosine=0.98)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector; every seventh vector's label is moved on by one first."""
    rows = read(spark, sf_dir, "embeddings")
    return hard_negatives.hard_negatives(spark, rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language mixture of all documents."""
    return language.identify(spark, read(spark, sf_dir, "documents"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of 64 components with the cluster that ten rounds give them."""
    return centroids.lloyd(spark, read(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_toxicity, op3_source_mixing, op4_url_filters, op5_ngram_jaccard_join, op6_warc_revisits, op7_quality_classifier, op8_packing, op9_media_columns, op10_embedding_near_dedup, op11_hard_negatives, op12_language_id, op13_centroid_clustering)}
ORACLES: dict[str, str] = {
    "op1_line_dedup": f"WITH {line_dedup.dedup_sql()} SELECT doc_id, text, _lines AS n_lines, _dropped AS n_dropped FROM deduped",
    "op3_source_mixing": f"WITH {mixing.mix_sql()} SELECT doc_id, source, lang, _topic AS topic, _tokens AS n_tokens, round(_p, 6) AS probability, _kept AS kept FROM mixed",
    "op4_url_filters": url_filter.filter_sql(),
    "op6_warc_revisits": revisits.resolve_sql(),
    "op11_hard_negatives": hard_negatives.hard_negatives_sql(),
    "op13_centroid_clustering": centroids.lloyd_sql(),
}
