"""The driver's parquet tables and the retail views derived from them.

The shipped tables hold no supermarket receipts, so the retail inputs are
derived with Spark from the order tables: a receipt is an order, the date is
the order date, the branch is the customer's nation, the customer is the
order's customer and every line item is one product unit.  The category
bridge comes from ``part`` (brand number, mapped only for sizes up to 25, plus
duplicate size-based mappings for sizes up to 10) so that about half of the
units stay uncategorised, as in the real data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions.dates import iso_date


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _orders_with_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    # orders (1 row per receipt) meet customer before the much larger lineitem
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        "o_orderkey",
        F.to_date("o_orderdate").alias("fecha"),
        F.col("c_nationkey").cast("int").alias("sucursal_id"),
        F.col("o_custkey").cast("int").alias("cliente_id"),
    )


def proxy_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per product unit: fecha, sucursal_id, cliente_id, producto_id, o_orderkey."""
    lineitem = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    receipts = _orders_with_branch(spark, sf_dir)
    return receipts.join(lineitem, receipts.o_orderkey == lineitem.l_orderkey).select(
        "fecha",
        "sucursal_id",
        "cliente_id",
        F.col("l_partkey").cast("int").alias("producto_id"),
        "o_orderkey",
    )


def proxy_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw receipt lines: fecha (text), sucursal_id, cliente_id, productos_raw.

    Line items are folded per order *before* meeting the order table, so the
    join sees one row per receipt and the lineitem side is already hash
    partitioned on the order key.
    """
    lineitem = read_table(spark, sf_dir, "lineitem")
    per_order = lineitem.groupBy("l_orderkey").agg(
        F.array_join(F.array_sort(F.collect_list(F.col("l_partkey").cast("int"))), " ").alias("productos_raw")
    )
    receipts = _orders_with_branch(spark, sf_dir)
    return receipts.join(per_order, receipts.o_orderkey == per_order.l_orderkey).select(
        iso_date("fecha").alias("fecha"), "sucursal_id", "cliente_id", "productos_raw"
    )


def proxy_product_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand mapping for p_size <= 25, plus a second (size) mapping for p_size <= 10.

    One scan of ``part``: each qualifying part emits its one or two mappings
    through an explode (the same rows as a UNION ALL of two filtered scans).
    """
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    brand = F.expr("substring(p_brand, 7)").cast("int")
    size = F.col("p_size").cast("int")
    mappings = F.when(F.col("p_size") <= 10, F.array(brand, size)).otherwise(F.array(brand))
    return part.filter(F.col("p_size") <= 25).select(
        F.col("p_partkey").cast("int").alias("producto_id"), F.explode(mappings).alias("categoria_id")
    )


def proxy_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part").select("p_brand")
    return part.select(
        F.expr("substring(p_brand, 7)").cast("int").alias("categoria_id"),
        F.col("p_brand").alias("nombre_categoria"),
    ).distinct()
