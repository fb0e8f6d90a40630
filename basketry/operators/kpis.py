"""Headline KPIs and top-k reports.

Top-k reports order by the measure descending and break ties by the id (or
date) ascending so that results are deterministic; ``orderBy(...).limit(k)``
plans as TakeOrderedAndProject (per-partition top-k, then a k-row merge).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.dates import iso_date, weekday_label, weekday_number
from basketry.functions.text import (
    CUSTOMER_PREFIX,
    HOVER_SEPARATOR,
    PRODUCT_PREFIX,
    VISITS_SUFFIX,
    prefixed_label,
    thousands,
)


def total_units(enriched: DataFrame) -> DataFrame:
    """Units sold; 0 (not null) on an empty fact."""
    return enriched.agg(F.coalesce(F.sum("cantidad"), F.lit(0)).cast("bigint").alias("value"))


def total_visits(visits: DataFrame) -> DataFrame:
    return visits.agg(F.count(F.lit(1)).alias("value"))


def unique_counts(enriched: DataFrame) -> DataFrame:
    """Distinct customers and products (computed, not constants).

    One distinct count per aggregate, the second as a scalar, so that no row of the fact is expanded.
    """
    products = enriched.agg(F.count_distinct("producto_id").alias("n"))
    return enriched.agg(F.count_distinct("cliente_id").alias("n_clientes")).withColumn("n_productos", products.scalar())


def product_fold(enriched: DataFrame) -> DataFrame:
    """Units per product and category: the fact's columns that the product and category KPIs read, a row a product."""
    return enriched.groupBy("producto_id", "categoria_id", "nombre_categoria").agg(F.sum("cantidad").cast("bigint").alias("cantidad"))


def product_units(enriched: DataFrame) -> DataFrame:
    return enriched.groupBy("producto_id").agg(F.sum("cantidad").cast("bigint").alias("total_cantidad"))


def top_products(enriched: DataFrame, k: int = 10) -> DataFrame:
    top = product_units(enriched).orderBy(F.desc("total_cantidad"), F.asc("producto_id")).limit(k)
    return top.select(
        "producto_id",
        prefixed_label(PRODUCT_PREFIX, "producto_id").alias("label"),
        "total_cantidad",
        thousands("total_cantidad").alias("texto"),
    )


def customer_visits(visits: DataFrame) -> DataFrame:
    return visits.groupBy("cliente_id").agg(F.count(F.lit(1)).alias("n_transacciones"))


def top_customers(visits: DataFrame, k: int = 10) -> DataFrame:
    top = customer_visits(visits).orderBy(F.desc("n_transacciones"), F.asc("cliente_id")).limit(k)
    return top.select(
        "cliente_id",
        prefixed_label(CUSTOMER_PREFIX, "cliente_id").alias("label"),
        "n_transacciones",
        thousands("n_transacciones").alias("texto"),
    )


def daily_counts(visits: DataFrame) -> DataFrame:
    """Visits per date present (DATE-typed; no calendar filling)."""
    return visits.groupBy("fecha").agg(F.count(F.lit(1)).alias("n_transacciones"))


def daily_visits(visits: DataFrame) -> DataFrame:
    """Chronological series with ISO date text."""
    return daily_counts(visits).orderBy("fecha").select(iso_date("fecha").alias("fecha"), "n_transacciones")


def peak_days(visits: DataFrame, k: int = 30) -> DataFrame:
    """Top-k days by visits, re-sorted by date, with weekday and hover text."""
    top = daily_counts(visits).orderBy(F.desc("n_transacciones"), F.asc("fecha")).limit(k)
    dow = weekday_number("fecha")
    fecha_txt = iso_date("fecha")
    return top.orderBy("fecha").select(
        fecha_txt.alias("fecha"),
        "n_transacciones",
        dow.alias("dia_semana"),
        weekday_label(dow).alias("dia"),
        F.concat_ws(
            HOVER_SEPARATOR,
            fecha_txt,
            weekday_label(dow),
            F.concat(thousands("n_transacciones"), F.lit(VISITS_SUFFIX)),
        ).alias("hover"),
    )
