"""The registered queries of this subpackage; each runs over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm import (
    chat_perspectives, decontaminate, fingerprints, hard_negatives, language_id, mixing, near_dedup, oracle, pii, quality,
    sharding, signature_join, spelling, url_filter,
)
from basketry.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict_languages(table(spark, sf_dir, "documents"))


def op2_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_perspectives.rotate_perspectives(table(spark, sf_dir, "conversations"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), url_filter.default_rules(spark))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality.score_documents(docs, labels)
    return scored.select("doc_id", "text_score", "meta_score", "score", "kept")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), n=3, percent=85)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 50 == 0)


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_join.jaccard_components(table(spark, sf_dir, "documents"), n=4, percent=85)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of at least 7 letters; in one of 31 occurrences, by a checksum, a letter is dropped (a null doc_id reads as '')."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(spelling.runs(F.col("text"), 7)).alias("run"))
    check = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    at = F.pmod(F.col("check"), F.length("run")).cast("int")
    dropped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.withColumn("check", check).select(F.when(F.col("check") % 31 == 0, dropped).otherwise(F.col("run")).alias("word"))
    return spelling.group_variants(spelling.vocabulary(words, 7, 2))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    "op1_language_id": op1_language_id,
    "op2_perspectives": op2_perspectives,
    "op4_url_filter": op4_url_filter,
    "op3_quality": op3_quality,
    "op5_decontamination": op5_decontamination,
    "op6_mixing": op6_mixing,
    "op7_fingerprints": op7_fingerprints,
    "op8_sharding": op8_sharding,
    "op9_near_dedup": op9_near_dedup,
    "op10_pii": op10_pii,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_jaccard_join": op12_jaccard_join,
    "op13_spelling": op13_spelling,
    "pipeline": pipeline,
}

#: The other operators hash, sample or learn in ways that SQL on another engine cannot repeat: tests hold them to brute force.
ORACLE_SQL: dict[str, str] = {"op4_url_filter": url_filter.oracle_sql(), **oracle.ORACLE_SQL}
