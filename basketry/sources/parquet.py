"""Partitioned Parquet sink and scan of the enriched fact, and KPI marts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.schemas import ENRICHED_COLUMNS, LOTE_COLUMN
from basketry.sources.snapshots import PARTITION_COLUMN, current


def write_enriched(df: DataFrame, path: str) -> None:
    """Write the fact to a plain folder partitioned by branch and slice, replacing only the slices that ``df`` holds.

    ``partitionOverwriteMode=dynamic`` is set on this write only.  It is meant for a fact written at once (``lote`` is 0);
    the ETL job and the stream keep a versioned table, see :mod:`basketry.sources.snapshots`.  AQE's rebalance splits a
    dominant branch over many tasks and merges small ones before the write, whatever joins ran before.
    """
    lote = F.col(LOTE_COLUMN) if LOTE_COLUMN in df.columns else F.lit(0).cast("bigint")
    (
        df.select(*ENRICHED_COLUMNS, lote.alias(LOTE_COLUMN))
        .hint("rebalance", PARTITION_COLUMN, LOTE_COLUMN)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(PARTITION_COLUMN, LOTE_COLUMN)
        .parquet(path)
    )


def read_enriched(spark: SparkSession, path: str, branches: Iterable[int] | None = None) -> DataFrame:
    """Scan the fact, of a versioned table its newest version; a branch list becomes a partition filter."""
    pinned = current(spark, path)
    if pinned is not None:
        return pinned.fact(branches)
    df = spark.read.parquet(path)
    if branches is not None:
        df = df.filter(F.col(PARTITION_COLUMN).isin(list(branches)))
    return df.select(*ENRICHED_COLUMNS)


def write_mart(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Overwrite one result mart (``parquet`` or ``json`` lines)."""
    df.write.mode("overwrite").format(fmt).save(path)


def read_mart(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(path)
