"""Corpus pipeline over `documents`; each stage works on all that the one before it kept.

1. quality: documents that the additive quality model scores below 0.7 go, and those without a word.
2. lines: recurring line templates go, all but their first line; documents of
   which nothing is left go with them (all they held stands in others).
3. near_duplicates: of each group of documents linked at a five-word shingle
   similarity of 0.8 or more, the one with the smallest id stays (one row of it).
4. mixing: documents are drawn to the target weights of source, language and topic.
5. packing: token sequences along a space-filling curve (the last stage's rows
   are pieces, not documents).

A stage's input may hold nulls in any column, repeated rows, empty texts and
columns of other names; stages 1 to 4 return the columns they were given.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import line_dedup, mixing, packing, quality
from lectern.llm.ngram_join import near_duplicates
from lectern.llm.workspace import Workspace, free_names, read

#: A character of a word.
WORD = r"[^ \t\n\r\f\x0b]"


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored at least 0.7 stay.  Texts without a word have no quality to speak of and go."""
    model = quality.train(spark, docs, read(spark, sf_dir, "labels"))
    scored = quality.keep_quality(spark, docs, model, cut=0.7)
    return scored.where(F.col("text").rlike(WORD))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without recurring lines, and without documents of which no word is left; n_chars follows the text where there is such a column."""
    lines, dropped = free_names(docs.columns, "lines", "dropped")
    out = line_dedup.dedup_lines(spark, docs, n_lines=lines, n_dropped=dropped).where((F.col(dropped) == 0) | F.col("text").rlike(WORD))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(dropped) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group stays, once; rows without an id or without words are in no group and stay."""
    ws = Workspace(spark, "others")
    groups = ws.write(near_duplicates(spark, docs, n=5, num=4, den=5), "groups")
    others = ws.write(groups.where("doc_id != component_id").select("doc_id").distinct(), "others")
    several = ws.write(groups.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "several")
    left = docs.join(others, "doc_id", "left_anti").select(docs.columns)
    if several.isEmpty():
        return left
    # an id of several rows is one document of its group
    words = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    own = left.join(several, "doc_id", "left_semi").select(docs.columns)
    rest = left.join(several, "doc_id", "left_anti").select(docs.columns)
    return rest.unionByName(own.where(~words)).unionByName(own.where(words).dropDuplicates(["doc_id"]))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The drawn documents."""
    added = free_names(docs.columns, "tokens", "topic", "p", "kept")
    return mixing.mix(spark, docs, added=tuple(added)).where(F.col(added[3])).select(docs.columns)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(spark, docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality", drop_low_quality),
    ("lines", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_documents),
]
#: The first and the last stage are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    ws = Workspace(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = ws.write(docs, name)
    return docs
