"""The corpus pipeline: quality, near duplicates, decontamination, mixing, sharding, each stage written and reread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from basketry.llm.common import materialise, table
from basketry.llm.decontaminate import decontaminate
from basketry.llm.mixing import mixed_documents
from basketry.llm.near_dedup import deduplicate
from basketry.llm.quality import good_documents
from basketry.llm.sharding import shard_rows

N_SHARDS = 16


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with a Jaccard similarity of 0.8 or more over five-word shingles."""
    return deduplicate(docs, n=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources at their target weights: documents, or the parts of them, once per epoch taken."""
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and slot."""
    return shard_rows(docs, N_SHARDS, ["doc_id", "source", "n_chars", "text"])


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: The classifier's fit cannot be said in SQL; tests compare the later stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
