"""The corpus pipeline: each stage works on all documents that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailnet.llm import decontamination, language_id, line_dedup, minhash_dedup, packing
from trailnet.llm.common import discard, materialize, table, without, written

#: SQL cannot express the stages; tests/llm/test_pipeline.py holds each against a brute-force version.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or of no language that the network tells with a probability of a half go. lang stays as it is."""
    return language_id.told(docs, language_id.learned(docs), 0.5)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines go that an earlier one equals or nearly equals; documents that have no words left go."""
    return line_dedup.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more) stays; rows with one doc_id, or with none, stay or go together."""
    since = len(written())
    judged = minhash_dedup.near_duplicates(docs, shingle_words=5, percent=80)
    gone = materialize(judged.groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).where("NOT kept").select("doc_id"))
    discard(spark, since)
    return without(docs, "doc_id", gone)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold much of a benchmark item go."""
    since = len(written())
    found = materialize(decontamination.overlaps(docs, table(spark, sf_dir, "benchmark")).select("key").distinct())
    discard(spark, since)
    key = "_key" + "_" * max(map(len, docs.columns))  # no column of docs
    return without(docs.withColumn(key, F.xxhash64("text")), key, found).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in bins of the permitted lengths."""
    return packing.pack_documents(docs)


STAGES = [("language_id", language), ("line_dedup", lines), ("minhash_near_dedup", near_dedup), ("decontamination", benchmark), ("best_fit_packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, since = table(spark, sf_dir, "documents"), len(written())
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
        discard(spark, since)
    return docs
