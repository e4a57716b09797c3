"""The corpus pipeline: quality rules, near-duplicates, benchmark decontamination, mixing to target weights, sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowspark.llm import decontamination, mixing, near_copies, quality, sharding
from flowspark.llm._shared import scratch, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base limits and lie near the robust centre of their language and source."""
    return quality.filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose shingles of 5 words are linked by a Jaccard similarity of 0.8 or more."""
    return near_copies.deduplicated(docs, width=5)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no 10 words in a row with the benchmark."""
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix at 150% of their words takes them."""
    return mixing.mixed(docs, weights=(5.0, 2.0, 1.0), share=1.5, max_epochs=2.0)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each row lies in the compacted shards."""
    return sharding.placements(*sharding.sharded(docs, scratch(spark, "shards")))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mix),
    ("sharding", shards),
]
#: Fitted covariances, fingerprints and shard files have no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what one returns is written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if not k else written(docs, "stage"), sf_dir)
    return docs
