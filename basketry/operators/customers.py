"""Per-customer features, their correlation matrix and box statistics."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.stats import safe_corr
from basketry.functions.text import feature_label
from basketry.operators.visits import visits as visits_of
from basketry.session import scratch_path

FEATURES = ["frecuencia", "total_cantidad", "productos_distintos", "categorias_distintas"]
# Fixed value: box-plot fence factor (Tukey).
FENCE_FACTOR = 1.5


def customer_units(enriched: DataFrame) -> DataFrame:
    return enriched.groupBy("cliente_id").agg(F.sum("cantidad").cast("bigint").alias("total_cantidad"))


def customer_features(enriched: DataFrame, visits: DataFrame | None = None) -> DataFrame:
    """cliente_id, frecuencia, total_cantidad, productos_distintos, categorias_distintas.

    ``frecuencia`` = distinct (fecha, sucursal_id) = visits of the customer;
    distinct counts ignore nulls (a customer with no categorised unit has 0
    categories).  The fact is folded per (customer, product) and per (customer,
    category), both with map-side reduction and without collecting sets; the
    customer's figures are plain totals of the two folds, so a product that
    changed its category counts once.  ``visits`` supply
    ``frecuencia``; they are derived from the fact unless passed in (a fact
    without ``fecha``, as the per-branch partials are, needs them).
    """
    if visits is None:
        if "fecha" not in enriched.columns:
            raise ValueError("visits are required when the input has no fecha column")
        visits = visits_of(enriched)
    per_product = enriched.groupBy("cliente_id", "producto_id").agg(F.sum("cantidad").cast("bigint").alias("units"))
    per_category = enriched.filter(F.col("categoria_id").isNotNull()).select("cliente_id", "categoria_id").distinct()
    no = F.lit(None)
    folds = per_product.select("cliente_id", "units", F.col("producto_id").alias("product"), no.cast("int").alias("category")).union(
        per_category.select("cliente_id", no.cast("bigint"), no.cast("int"), "categoria_id")
    )
    rest = folds.groupBy("cliente_id").agg(
        F.sum("units").alias("total_cantidad"),
        F.count("product").alias("productos_distintos"),
        F.count("category").alias("categorias_distintas"),
    )
    frequency = visits.groupBy("cliente_id").agg(F.count(F.lit(1)).alias("frecuencia"))
    return rest.join(frequency, "cliente_id", "left").select(
        "cliente_id",
        F.coalesce(F.col("frecuencia"), F.lit(0)).cast("bigint").alias("frecuencia"),
        "total_cantidad",
        "productos_distintos",
        "categorias_distintas",
    )


def correlation_matrix(features: DataFrame, columns: list[str] = FEATURES, digits: int = 6) -> DataFrame:
    """Long-form Pearson matrix (var_x, var_y, r) with display labels.

    All pairs are computed by ONE global aggregate (partial per partition, a
    single tiny merge); the matrix is then unpivoted from that one row.  A
    constant feature gives null instead of an error.
    """
    pairs = list(itertools.combinations_with_replacement(columns, 2))
    aggs = [safe_corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]
    one_row = features.agg(*aggs)
    entries = []
    for i, (a, b) in enumerate(pairs):
        r = F.round(F.col(f"c{i}"), digits)
        entries.append(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), r.alias("r")))
        if a != b:
            entries.append(F.struct(F.lit(b).alias("x"), F.lit(a).alias("y"), r.alias("r")))
    long = one_row.select(F.inline(F.array(*entries)))
    return long.select(
        feature_label("x").alias("var_x"),
        feature_label("y").alias("var_y"),
        "r",
    )


@dataclass(frozen=True)
class Box:
    """Quartiles (R-7) and Tukey fences of a column; all None without values."""

    q1: float | None = None
    median: float | None = None
    q3: float | None = None
    lo: float | None = None
    hi: float | None = None


def exact_quantiles(values: DataFrame, column: str, shares: Sequence[float]) -> list[float | None]:
    """Exact quantiles with linear interpolation (R-7) by rank selection, with no task that sorts all values.

    The histogram (one row per distinct value) is range-partitioned and written with its bucket, the partition; the
    buckets' totals, one row each, give every bucket's first rank.  Only the buckets that hold a wanted rank are sorted,
    each in a task of its own, and give at most two values a quantile.  Nulls are left out.
    """
    spark = values.sparkSession
    path = scratch_path(spark, "histogram")
    counts = values.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("freq"))
    counts.repartitionByRange("v").withColumn("bucket", F.spark_partition_id()).write.parquet(path)
    hist = spark.read.schema(f"v {values.schema[column].dataType.simpleString()}, freq long, bucket int").parquet(path)
    buckets = hist.groupBy("bucket").agg(F.sum("freq").alias("freq")).orderBy("bucket").collect()
    total = sum(b["freq"] for b in buckets)
    if not total:
        return [None] * len(shares)
    places = [share * (total - 1) for share in shares]
    ranks = sorted({math.floor(p) for p in places} | {math.ceil(p) for p in places})
    first, start = {}, 0
    for b in buckets:
        if any(start <= r < start + b["freq"] for r in ranks):
            first[b["bucket"]] = start
        start += b["freq"]
    offset = F.element_at(F.create_map(*[F.lit(x).cast("bigint") for kv in first.items() for x in kv]), F.col("bucket").cast("bigint"))
    until = F.sum("freq").over(Window.partitionBy("bucket").orderBy("v")) + offset
    ranked = hist.filter(F.col("bucket").isin(list(first))).select("v", "freq", until.alias("until"))
    wanted = F.exists(F.array(*[F.lit(r) for r in ranks]), lambda r: (r < F.col("until")) & (r >= F.col("until") - F.col("freq")))
    found = sorted((r["until"], r["v"]) for r in ranked.filter(wanted).collect())
    at = lambda rank: float(next(v for until, v in found if rank < until))
    return [at(math.floor(p)) + (p - math.floor(p)) * (at(math.ceil(p)) - at(math.floor(p))) for p in places]


def box(values: DataFrame, column: str = "total_cantidad") -> Box:
    """Quartiles and fences as plain numbers."""
    q1, median, q3 = exact_quantiles(values, column, (0.25, 0.5, 0.75))
    if q1 is None:
        return Box()
    return Box(q1, median, q3, q1 - FENCE_FACTOR * (q3 - q1), q3 + FENCE_FACTOR * (q3 - q1))


def box_stats(values: DataFrame, column: str = "total_cantidad", fences: Box | None = None) -> DataFrame:
    """q1, mediana, q3, media, bigote_inf, bigote_sup, n_outliers (one row).

    Whiskers are the extreme values inside the 1.5*IQR fences (Tukey); with
    the fences as scalars, one aggregate over the values.
    """
    b = fences or box(values, column)
    v, number = F.col(column), lambda x: F.lit(x).cast("double")
    inside = (v >= number(b.lo)) & (v <= number(b.hi))
    return values.agg(
        number(b.q1).alias("q1"),
        number(b.median).alias("mediana"),
        number(b.q3).alias("q3"),
        (F.sum(v) / F.count(v)).cast("double").alias("media"),
        F.min(F.when(inside, v)).cast("double").alias("bigote_inf"),
        F.max(F.when(inside, v)).cast("double").alias("bigote_sup"),
        F.count(F.when(~inside, v)).alias("n_outliers"),
    )


def outliers(
    values: DataFrame, column: str = "total_cantidad", key: str = "cliente_id", fences: Box | None = None
) -> DataFrame:
    """Rows outside the 1.5*IQR fences: a filter with two scalars."""
    b = fences or box(values, column)
    v, number = F.col(column), lambda x: F.lit(x).cast("double")
    return values.filter((v < number(b.lo)) | (v > number(b.hi))).select(key, column)
