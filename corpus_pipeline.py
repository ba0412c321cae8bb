"""A corpus from documents: quality, near duplicates, benchmark passages, mixture, shards.

Each stage works on all that the one before it kept, and its decisions take effect: documents that a filter
rejects are gone, documents the mixture repeats are there several times, and the last stage places every row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigilake.llm import decontamination, jaccard_join, mixing, quality, sharding
from vigilake.llm.common import small_batches, store


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents whose vote is below the threshold go."""
    return quality.accept(docs, _table(spark, sf_dir, "labels"))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: shingles of five words, similarity 0.8 or more; the smallest doc_id of a group stays."""
    small_batches(spark)
    return jaccard_join.keep_first(docs, words=5, percent=80)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that hold a window of a benchmark item go."""
    return decontamination.remove_documents(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: sources at their target weights, a row per epoch."""
    small_batches(spark)
    return mixing.mix(docs)


def place_in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: every row's shard and slot along the Hilbert curve."""
    small_batches(spark)
    return sharding.hilbert_shards(docs).select("doc_id", "size", "text_crc32", "curve", "shard", "slot")


STAGES = [
    ("quality_classifier", accept_quality),
    ("ngram_jaccard_join", keep_one_of_near_duplicates),
    ("benchmark_decontamination", remove_benchmark),
    ("source_mixing", mix_sources),
    ("hilbert_sharding", place_in_shards),
]

#: the classifier of the first stage cannot be expressed in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's rows are stored as Parquet and read again by the next."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
