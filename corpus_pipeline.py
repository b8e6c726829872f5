"""The corpus pipeline: five stages, each on all that its predecessor kept, each written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, mixture, nearcopies, pii, toxicity
from tidemark.llm.common import stash

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject."""
    return toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).keep_clean(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose five-word shingles reach Jaccard 0.8; candidates come by SimHash and by MinHash bands."""
    return nearcopies.drop_near_copies(docs)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of benchmark passages; those that are mostly benchmark go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def anonymous(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked and disclosing terms generalised or removed."""
    return pii.sanitise(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them."""
    return mixture.mix(docs)


STAGES: list[tuple[str, Stage]] = [("toxicity", clean), ("near_dedup", distinct), ("decontamination", unseen), ("pii", anonymous), ("mixture", mixed)]

#: SQL expresses neither the network nor XXH64 fingerprints; tests/llm holds the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
