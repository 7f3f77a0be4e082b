"""The corpus pipeline: language ID, line dedup, near-duplicate removal, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Every stage works on all rows its predecessor kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import jaccard_join, language_id, line_dedup, mixing, packing
from kinfold.llm.common import shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near-duplicates: shingles of five words, similarity of 8/10 or more.
SHINGLE_WORDS, SIMILAR = 5, (8, 10)
_HAS_WORD = "[^\\x20\\x09-\\x0D]"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or too far from every language's centroids, go; a missing lang is filled in.

    Null and empty texts go; repeated rows are judged alike. Without any labelled row there is nothing to judge by, and
    every document stays as it is.
    """
    model = language_id.fit(docs)
    if not model.languages:
        return docs.select(*COLUMNS)
    told = language_id.annotate(docs.select(*COLUMNS), model).where("not rejected")
    return told.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates and shared passages go from all documents but the first; a document that had nothing else goes too.

    Null and empty texts stay; repeated rows are one document and keep the same lines; rows without doc_id keep all.
    """
    out = line_dedup.clean(docs.select(*COLUMNS)).where((F.col("n_dropped") + F.col("n_cut") == 0) | F.col("text").rlike(_HAS_WORD) | F.col("text").isNull())
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the smallest id.

    Rows repeated with one id and text stay once; one id with different texts is as many documents. Rows without an id
    stay, as do null and empty texts.
    """
    kept = jaccard_join.groups(docs, SHINGLE_WORDS, *SIMILAR).where("kept and doc_id is not null").select(F.col("doc_id").alias("id"), "key")
    keyed = docs.select(*COLUMNS, F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("key"))
    named = keyed.join(kept.distinct(), ["id", "key"], "left_semi").dropDuplicates(["id", "key"])
    return named.select(*COLUMNS).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words the mix takes: a row for each document and pass over its source, cut to the blocks drawn in that pass.

    Texts without words are not taken; a null source is a source; repeated rows are documents of their own.
    """
    return mixing.mixed_texts(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document the mix holds, packed into sequences: one row per piece. A null text is its closing id alone."""
    return packing.pack(docs, with_ids=False)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Hash-drawn blocks, trained centroids and tokens are beyond SQL; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order. Each is written and read again; what a stage has read is deleted, but for documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{before}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
