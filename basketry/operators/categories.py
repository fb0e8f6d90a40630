"""Category shares and the small-share bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Share threshold (percent) and the name of the merged bucket.
SMALL_SHARE_THRESHOLD = 3.0
SMALL_SHARE_BUCKET = "Otros"


def category_share(enriched: DataFrame, with_pct_all: bool = False) -> DataFrame:
    """Per named category: units, distinct products and percent of the
    categorised units, sorted by units (ties: name).

    The fact is scanned and aggregated once.  The denominator is a sum over
    the already aggregated per-category rows (an un-partitioned window whose
    input is one row per category, bounded by the category dimension, not by
    the fact).  A scalar subquery would re-aggregate the fact.
    ``pct = round(units / total * 100, 2)`` (HALF_UP).

    ``with_pct_all`` adds ``pct_all``, the share of *all* units (uncategorised
    included).  The null category is then kept as one more group so that both
    denominators come from the same single aggregation, and dropped after.
    """
    source = enriched if with_pct_all else enriched.filter(F.col("nombre_categoria").isNotNull())
    per_cat = source.groupBy("nombre_categoria").agg(
        F.sum("cantidad").cast("bigint").alias("total_cantidad"),
        F.count_distinct("producto_id").alias("n_productos"),
    )
    whole = Window.partitionBy()
    named = F.col("nombre_categoria").isNotNull()
    total = F.sum(F.when(named, F.col("total_cantidad"))).over(whole)
    pct = F.round(F.col("total_cantidad").cast("double") / total.cast("double") * F.lit(100.0), 2)
    cols = ["nombre_categoria", "total_cantidad", "n_productos", pct.alias("pct")]
    if with_pct_all:
        all_units = F.sum("total_cantidad").over(whole)
        cols.append(
            F.round(F.col("total_cantidad").cast("double") / all_units.cast("double") * F.lit(100.0), 2).alias("pct_all")
        )
    return (
        per_cat.select(*cols)
        .filter(named)
        .orderBy(F.desc("total_cantidad"), F.asc("nombre_categoria"))
    )


def category_pie(
    share: DataFrame,
    threshold: float = SMALL_SHARE_THRESHOLD,
    bucket: str = SMALL_SHARE_BUCKET,
) -> DataFrame:
    """Categories whose (rounded) pct is below ``threshold`` merge into one
    bucket whose pct is the rounded sum of their rounded pcts; the bucket is
    present only when it holds units.  Sorted by units descending."""
    small = F.col("pct") < F.lit(threshold)
    grouped = share.groupBy(
        small.alias("_small"),
        F.when(small, F.lit(bucket)).otherwise(F.col("nombre_categoria")).alias("nombre_categoria"),
    ).agg(
        F.sum("total_cantidad").cast("bigint").alias("total_cantidad"),
        F.round(F.sum("pct"), 2).alias("pct"),
    )
    return (
        grouped.filter(F.col("total_cantidad") > 0)
        .select("nombre_categoria", "total_cantidad", "pct")
        .orderBy(F.desc("total_cantidad"), F.asc("nombre_categoria"))
    )
