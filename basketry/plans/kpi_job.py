"""KPI job: every KPI and chart dataset from a few folds of the enriched fact.

The narrow ``visits`` mart (reused by five KPIs), the units per product and
category (reused by the scalar KPIs, the top products and the shares), the
customers' features and units (reused by the correlation, box statistics and
outliers) and the per-category share (reused by the pie) are folded from the
fact once and persisted MEMORY_AND_DISK for the duration of the job; a
lost executor only means those blocks are recomputed from lineage.  The
wide fact itself is never cached: each KPI's scan is column-pruned Parquet.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.operators import categories, customers, kpis, series
from basketry.operators.visits import visits as visits_of
from basketry.sources.parquet import write_mart
from basketry.sources.runlog import append_event, claimed, read_log
from basketry.sources.snapshots import snapshot


def kpi_bundle(enriched: DataFrame, visits: DataFrame | None = None) -> DataFrame:
    """Scalar KPIs in long form (kpi, value) from two folds of the fact.

    The fold per product and category gives units and categories, and once
    more per product the products; the visits give visits and customers.  Each
    fold reduces map-side, and each total holds one distinct count at most, so
    no row of the fact is expanded.  A product may change its category between
    dimension files: it is one product, uncovered if any unit has no category.
    """
    zero = lambda total: F.coalesce(total, F.lit(0)).cast("bigint")
    per_category = enriched.groupBy("producto_id", "categoria_id", "nombre_categoria").agg(F.sum("cantidad").alias("units"))
    unnamed = F.when(F.col("nombre_categoria").isNull(), F.col("units"))
    product = F.struct(
        F.lit(True).alias("product"), F.col("producto_id").cast("string").alias("key"), F.col("units"),
        unnamed.alias("unnamed"), F.col("categoria_id").isNull().alias("uncovered"),
    )
    no_units = F.lit(None).cast("bigint")
    name = F.struct(
        F.lit(False).alias("product"), F.col("nombre_categoria").alias("key"), no_units.alias("units"),
        no_units.alias("unnamed"), F.lit(False).alias("uncovered"),
    )
    # two rows for each row of the fold, not of the fact
    per_key = per_category.select(F.inline(F.array(product, name))).groupBy("product", "key").agg(
        F.sum("units").alias("units"), F.sum("unnamed").alias("unnamed"), F.max("uncovered").alias("uncovered")
    )
    count = lambda condition: F.count(F.when(condition & F.col("key").isNotNull(), F.lit(1)))
    products = per_key.agg(
        zero(F.sum("units")).alias("total_unidades"),
        count(F.col("product")).alias("productos_unicos"),
        count(~F.col("product")).alias("categorias_con_nombre"),
        zero(F.sum("unnamed")).alias("unidades_sin_categoria"),
        # coverage of the bridge by product (the unit-based share is the line above)
        count(F.col("product") & F.col("uncovered")).alias("productos_sin_categoria"),
    )
    people = (visits if visits is not None else visits_of(enriched)).agg(
        F.count(F.lit(1)).alias("total_visitas"), F.count_distinct("cliente_id").alias("clientes_unicos")
    )

    def long(one: DataFrame) -> DataFrame:
        named = [F.struct(F.lit(c).alias("kpi"), F.col(c).alias("value")) for c in one.columns]
        return one.select(F.inline(F.array(*named)))

    return long(products).union(long(people))


def chart_mart_builders(
    enriched: DataFrame,
    visits: DataFrame,
    units: DataFrame,
    share: DataFrame | None = None,
    fences: customers.Box | None = None,
    products: DataFrame | None = None,
    features: DataFrame | None = None,
) -> dict[str, Callable[[], DataFrame]]:
    """Deferred constructors of the chart datasets (analysis runs in the caller's thread)."""
    products = products if products is not None else enriched

    def share_df() -> DataFrame:
        return share if share is not None else categories.category_share(products)

    def features_df() -> DataFrame:
        return features if features is not None else customers.customer_features(enriched, visits)

    return {
        "top_products": lambda: kpis.top_products(products),
        "top_customers": lambda: kpis.top_customers(visits),
        "peak_days": lambda: kpis.peak_days(visits),
        "category_share": share_df,
        "category_pie": lambda: categories.category_pie(share_df()),
        "daily_series": lambda: series.rolling_7d(kpis.daily_counts(visits)),
        "customer_box": lambda: customers.box_stats(units, fences=fences),
        "customer_outliers": lambda: customers.outliers(units, fences=fences),
        "customer_corr": lambda: customers.correlation_matrix(features_df()),
    }


def chart_marts(
    enriched: DataFrame, visits: DataFrame, units: DataFrame, share: DataFrame | None = None
) -> dict[str, DataFrame]:
    return {k: build() for k, build in chart_mart_builders(enriched, visits, units, share).items()}


def run_kpis(
    enriched: DataFrame,
    mart_root: str,
    parallelism: int = 4,
    fmt: str = "parquet",
    visits: DataFrame | None = None,
) -> list[str]:
    """Compute and write every mart under ``mart_root``; returns mart names.

    The shared inputs are materialised first (so concurrent jobs do not race
    to build the same cache), then the independent mart writes are submitted
    from a small thread pool: Spark schedules concurrent jobs over the same
    executors, which fills the idle tail of each small job.  Marts are written
    together in one run, so a re-computation never leaves some of them stale.

    ``enriched`` may also be the per-branch customer/product partials (same
    columns minus ``fecha``, ``cantidad`` summed) together with the stored
    ``visits`` partial: every mart is then computed from those smaller
    tables (see :mod:`basketry.plans.partials`).  Every fold sums ``cantidad``,
    so partials of several slices need not be merged before.
    """
    visits = (visits if visits is not None else visits_of(enriched)).persist(StorageLevel.MEMORY_AND_DISK)
    products = kpis.product_fold(enriched).persist(StorageLevel.MEMORY_AND_DISK)
    # a row a customer, from the cached visits; the units are totals of its rows
    features = customers.customer_features(enriched, visits).persist(StorageLevel.MEMORY_AND_DISK)
    totals = features.select("cliente_id", F.col("total_cantidad").alias("cantidad"))
    units = customers.customer_units(totals).persist(StorageLevel.MEMORY_AND_DISK)
    # one row per named category; reused by the share and the pie marts
    share = categories.category_share(products).persist(StorageLevel.MEMORY_AND_DISK)
    shared = [visits, products, features, units, share]
    try:
        with ThreadPoolExecutor(max_workers=2) as pool:
            folded = pool.submit(lambda: products.count() and share.count())
            visits.count()
            features.count()
            fences = (units.count() and customers.box(units)) or customers.Box()
            folded.result()
        builders: dict[str, Callable[[], DataFrame]] = {"kpis": lambda: kpi_bundle(products, visits)}
        builders.update(chart_mart_builders(enriched, visits, units, share, fences, products, features))

        def build_and_write(name: str) -> None:
            # plan analysis of one mart overlaps the execution of the others
            write_mart(builders[name](), f"{mart_root}/{name}", fmt)

        with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
            for f in [pool.submit(build_and_write, name) for name in builders]:
                f.result()
        return list(builders)
    finally:
        for df in shared:
            df.unpersist()


def refresh_marts(
    spark: SparkSession,
    table_path: str,
    mart_root: str,
    partials_root: str | None = None,
    parallelism: int = 4,
    fmt: str = "parquet",
    force: bool = False,
    takeover: bool = False,
    wait_seconds: float = 0.0,
) -> list[str]:
    """Bring the marts up to the fact's newest version, from the fact or from its partials; none if they are already.

    The run is logged under ``mart_root`` before any mart is overwritten and after all are written, so that marts of a
    failed or killed run are known to be stale (:func:`mart_status`).  One run at a time, as for the table itself.
    """
    pinned = snapshot(spark, table_path)
    if not force and not mart_status(spark, mart_root, table_path).stale:
        return []
    with claimed(spark, mart_root, "kpis", takeover, wait_seconds) as run:
        run.detail["table_version"] = pinned.version
        append_event(spark, mart_root, run.run, "kpis", "building", run.version, run.detail)
        if partials_root:
            from basketry.plans.partials import refresh_partials, run_kpis_from_partials

            refresh_partials(spark, table_path, partials_root, takeover, wait_seconds)
            names = run_kpis_from_partials(spark, partials_root, mart_root, parallelism, fmt)
        else:
            names = run_kpis(pinned.fact(), mart_root, parallelism, fmt)
    return names


@dataclass(frozen=True)
class MartStatus:
    """Which version of the fact the marts show, which is the newest, and how the last KPI run ended."""

    shown: int | None
    newest: int
    last_event: str | None
    error: str | None = None

    @property
    def stale(self) -> bool:
        return self.last_event != "published" or self.shown != self.newest


def mart_status(spark: SparkSession, mart_root: str, table_path: str) -> MartStatus:
    """A started run that did not publish may have left a mix of old and new marts: then no version is shown."""
    newest = snapshot(spark, table_path).version
    last = read_log(spark, mart_root).orderBy(F.desc("seq")).limit(1).first()
    if last is None:
        return MartStatus(None, newest, None)
    detail = json.loads(last["detail"])
    shown = detail["table_version"] if last["event"] == "published" else None
    return MartStatus(shown, newest, last["event"], detail.get("error"))


MART_NAMES = [
    "kpis",
    "top_products",
    "top_customers",
    "peak_days",
    "category_share",
    "category_pie",
    "daily_series",
    "customer_box",
    "customer_outliers",
    "customer_corr",
]


def register_mart_views(spark, mart_root: str, fmt: str = "parquet", prefix: str = "kpi_") -> list[str]:
    """Expose every written mart as a temporary view (``kpi_top_products``, ...)
    so results are read with ``spark.sql`` -- the read side of each KPI."""
    from basketry.sources.parquet import read_mart

    names = []
    for name in MART_NAMES:
        view = f"{prefix}{name}"
        read_mart(spark, f"{mart_root}/{name}", fmt).createOrReplaceTempView(view)
        names.append(view)
    return names
