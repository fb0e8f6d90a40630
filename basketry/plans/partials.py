"""Partial aggregates of the fact: the KPI job's input, maintained by version.

Every KPI is additive once the fact is folded to partials (a branch is part of
the visit key, and distinct counts are re-derived from the folded rows):

* ``visits``            distinct (fecha, sucursal_id, cliente_id)
* ``customer_products`` units per (sucursal_id, cliente_id, producto_id) and
                        category, in a column named ``cantidad`` -- the fact's
                        layout minus ``fecha``, so the fact operators run on it
                        unchanged
* ``distincts``         bitmaps of the customers and products seen: exact
                        distinct counts that merge by OR

Each keeps the slice in its key and lies beside the versions of the fact, as
``version=N/sucursal_id=B``.  A version's rows never change, so a refresh folds
only versions that are new, superseded slices drop out on reading as they do in
the fact, and what is left is merged: a run that ingests one file costs a fold of
that file's rows, whatever branches they belong to.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.operators.visits import visits as visits_of
from basketry.plans.kpi_job import run_kpis
from basketry.schemas import LOTE_COLUMN, VISIT_KEY
from basketry.sources.runlog import claimed, last_published
from basketry.sources.snapshots import DATA_SCHEMA, PARTITION_COLUMN, Snapshot, current, live_rows, snapshot

PARTIAL_SCHEMAS = {
    "visits": "fecha date, sucursal_id int, cliente_id int, lote long",
    "customer_products": (
        "sucursal_id int, cliente_id int, producto_id int, categoria_id int, nombre_categoria string, cantidad long, lote long"
    ),
    "distincts": "sucursal_id int, kind string, bucket long, bits binary, lote long",
}
PARTIAL_NAMES = tuple(PARTIAL_SCHEMAS)
PRODUCT_KEY = ["sucursal_id", "cliente_id", "producto_id", "categoria_id", "nombre_categoria"]


def customer_products(enriched: DataFrame, *extra: str) -> DataFrame:
    """Units per (branch, customer, product) and category."""
    return enriched.groupBy(*PRODUCT_KEY, *extra).agg(F.sum("cantidad").cast("bigint").alias("cantidad"))


def distinct_bitmaps(enriched: DataFrame, *extra: str) -> DataFrame:
    """(branch, kind, bucket, bits): 4 kB bitmaps of the customers and products of a branch, 32,768 ids a bucket."""

    def bitmaps(kind: str, column: str) -> DataFrame:
        ids = enriched.filter(F.col(column).isNotNull()).select(PARTITION_COLUMN, *extra, column).distinct()
        bucket = F.bitmap_bucket_number(F.col(column)).alias("bucket")
        bits = F.bitmap_construct_agg(F.bitmap_bit_position(F.col(column))).alias("bits")
        return ids.groupBy(PARTITION_COLUMN, *extra, bucket).agg(bits).withColumn("kind", F.lit(kind))

    return bitmaps("customer", "cliente_id").unionByName(bitmaps("product", "producto_id"))


def fold(rows: DataFrame) -> dict[str, DataFrame]:
    """The partials of fact rows that carry their slice."""
    return {
        "visits": rows.select(*VISIT_KEY, LOTE_COLUMN).distinct(),
        "customer_products": customer_products(rows, LOTE_COLUMN),
        "distincts": distinct_bitmaps(rows, LOTE_COLUMN),
    }


def refresh_partials(
    spark: SparkSession, table_path: str, partials_root: str, takeover: bool = False, wait_seconds: float = 0.0
) -> list[int]:
    """Fold the versions of the fact that have not been folded yet; returns them."""
    if _folded(spark, table_path, partials_root)[1] == snapshot(spark, table_path).version:
        return []
    with claimed(spark, partials_root, "partials", takeover, wait_seconds) as run:
        pinned = snapshot(spark, table_path)
        done = set(_folded(spark, table_path, partials_root)[0])
        new = [v for v in pinned.versions if v not in done]

        def write(version: int, name: str, df: DataFrame) -> None:
            path = f"{partials_root}/{name}/version={version}"
            df.hint("rebalance", PARTITION_COLUMN).write.mode("overwrite").partitionBy(PARTITION_COLUMN).parquet(path)

        folds = [(v, n, df) for v in new for n, df in fold(pinned.rows("data", DATA_SCHEMA, [v])).items()]
        with ThreadPoolExecutor(max_workers=len(PARTIAL_NAMES)) as pool:  # small jobs side by side
            list(pool.map(lambda f: write(*f), folds))
        run.detail.update(table=table_path, table_version=pinned.version, folded=sorted(pinned.versions))
    return new


def _folded(spark: SparkSession, table_path: str, partials_root: str) -> tuple[list[int], int | None]:
    """The folded versions of the table, and the table's version that they show (None: not yet)."""
    row = last_published(spark, partials_root)
    detail = json.loads(row["detail"]) if row else {}
    return (detail["folded"], detail["table_version"]) if detail.get("table") == table_path else ([], None)


def _pinned(spark: SparkSession, partials_root: str) -> Snapshot:
    """The version of the fact that the partials show."""
    row = last_published(spark, partials_root)
    if row is None:
        raise ValueError(f"no partials under {partials_root}")
    detail = json.loads(row["detail"])
    return current(spark, detail["table"], detail["table_version"]) or Snapshot(spark, detail["table"])


def _live_partials(spark: SparkSession, partials_root: str) -> dict[str, DataFrame]:
    """The partials of every slice that is not superseded, as of the fact's version that they were refreshed to."""
    pinned = _pinned(spark, partials_root)
    return {n: live_rows(pinned, f"{partials_root}/{n}", schema) for n, schema in PARTIAL_SCHEMAS.items()}


def read_partials(spark: SparkSession, partials_root: str) -> dict[str, DataFrame]:
    """The partials merged over their slices, without superseded ones."""
    live = _live_partials(spark, partials_root)
    return {
        "visits": visits_of(live["visits"]),
        "customer_products": customer_products(live["customer_products"]),
        "distincts": live["distincts"].groupBy(PARTITION_COLUMN, "kind", "bucket").agg(F.bitmap_or_agg("bits").alias("bits")),
    }


def unique_counts_from_partials(distincts: DataFrame) -> DataFrame:
    """n_clientes, n_productos over all branches: exact, by OR of the branches' bitmaps."""
    whole = distincts.groupBy("kind", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))

    def count(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.bitmap_count("bits"))), F.lit(0)).cast("bigint")

    return whole.agg(count("customer").alias("n_clientes"), count("product").alias("n_productos"))


def run_kpis_from_partials(
    spark: SparkSession, partials_root: str, mart_root: str, parallelism: int = 4, fmt: str = "parquet"
) -> list[str]:
    """Every mart from the partials; its folds merge the slices' rows, so that these are not shuffled whole before each."""
    live = _live_partials(spark, partials_root)
    return run_kpis(live["customer_products"], mart_root, parallelism, fmt, visits=visits_of(live["visits"]))
