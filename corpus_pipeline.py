"""The corpus pipeline: five stages over documents, each written as Parquet and reread by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilstone.llm import decontamination, exact_dedup, mixing, simhash_dedup, toxicity, work


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.keep_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.keep_rows(docs)


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that share 0.8 of their five-word shingles, directly or in a chain, the smallest doc_id stays."""
    return simhash_dedup.keep_rows(docs)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.keep_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; copy counts from 1."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", _toxicity),
    ("exact_dedup", _exact_dedup),
    ("simhash_near_dedup", _near_dedup),
    ("benchmark_decontamination", _decontamination),
    ("mixing", _mixing),
]
#: SQL can't express the trained and fingerprinted stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = work.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
