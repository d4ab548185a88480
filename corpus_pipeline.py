"""The corpus pipeline: stages over documents, each written as Parquet and read by the next.

Rejected, repeated and unmixed documents go; all stages but the last return the columns of
documents. Every stage works on all rows that the one before it kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronaudit.llm import pair_index, secret_scan, simhash, site_quality, source_mix
from chronaudit.llm.common import reach_workers, scratch_path

SHINGLE_WORDS, MAX_BITS = 3, 2


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps.

    Null texts are judged as empty ones; null sources and languages are sites of their own;
    repeated rows and ids are judged each by its own text; texts count whole. Without labels
    of both classes every document stays. An empty table gives no rows.
    """
    reach_workers(spark)
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return site_quality.keep_good(docs, labels)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the least id, null ids last.

    Texts without words, null ones among them, are one group. Of rows with one id and
    fingerprint the one with the least digest stays. An empty table gives no rows.
    """
    reach_workers(spark)
    return simhash.keep_one(docs, shingle=SHINGLE_WORDS, max_bits=MAX_BITS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and their numbers of characters as they are then.

    Null texts stay null, with a null number. Every row stays, as often as it is repeated;
    whole texts are scanned, however long. An empty table gives no rows.
    """
    reach_workers(spark)
    masked = secret_scan.mask_secrets(docs)
    return masked.withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Sources without words go; a null source is a source. Of rows with one id and text some
    may be taken more often than others. An empty table gives no rows.
    """
    return source_mix.repeat_rows(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Numbers of tokens and digests of the ids and of what they decode to, for each row.

    Null texts count as empty, with no ids; texts count whole. An empty table gives no rows.
    """
    reach_workers(spark)
    return pair_index.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality),
    ("simhash", near_dedup),
    ("secrets", secrets),
    ("mixing", mixing),
    ("bpe", encoding),
]

#: SQL cannot express the classifier, the fingerprints or the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
