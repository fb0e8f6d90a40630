"""Registered queries: ``name -> fn(spark, sf_dir) -> DataFrame``.

Every query reads the driver's tables (or data Spark derives from them and
writes to a fresh folder under the shared checkpoint root) and processes
them whole.  The retail inputs are the proxy views of
:mod:`basketry.sources.tables`.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.operators import categories, customers, jobs, kpis, series
from basketry.operators.etl import dedupe_product_category, enrich_fact, explode_baskets, parse_dates, run_transformations
from basketry.operators.recommend import product_rules, visit_baskets
from basketry.operators.segments import segment_customers
from basketry.operators.visits import visits as visits_of
from basketry.plans.etl_job import run_etl
from basketry.plans.kpi_job import MART_NAMES, kpi_bundle, refresh_marts
from basketry.plans.partials import read_partials, refresh_partials, unique_counts_from_partials
from basketry.schemas import RAW_BASKET_SCHEMA
from basketry.session import scratch_path
from basketry.sources import csv as csv_io
from basketry.sources.manifest import branch_manifest, manifest_diff, source_manifest
from basketry.sources.parquet import read_enriched, read_mart, write_enriched
from basketry.sources.snapshots import load, snapshot
from basketry.sources.tables import (
    proxy_baskets,
    proxy_categories,
    proxy_fact,
    proxy_product_category,
    read_table,
)
from basketry.streaming.ingest import ingest_stream

Query = Callable[[SparkSession, str], DataFrame]


def enriched_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich_fact(
        proxy_fact(spark, sf_dir), proxy_product_category(spark, sf_dir), proxy_categories(spark, sf_dir)
    )


def enriched_via_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full ETL chain (receipt text -> parse -> explode -> enrich)."""
    return run_transformations(
        proxy_baskets(spark, sf_dir), proxy_product_category(spark, sf_dir), proxy_categories(spark, sf_dir)
    )


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipt lines tagged with their arrival batch (the order year)."""
    return proxy_baskets(spark, sf_dir).withColumn("arrival", F.substring("fecha", 1, 4).cast("int"))


# ---------------------------------------------------------------- ingest / ETL


def q_ingest_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = scratch_path(spark, "baskets")
    csv_io.write_baskets(proxy_baskets(spark, sf_dir), src)
    return csv_io.read_baskets(spark, src).select(*RAW_BASKET_SCHEMA.fieldNames())


def q_ingest_product_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = scratch_path(spark, "product_category")
    csv_io.write_product_category(proxy_product_category(spark, sf_dir), src)
    return csv_io.read_product_category(spark, src)


def q_ingest_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = scratch_path(spark, "categories")
    csv_io.write_categories(proxy_categories(spark, sf_dir), src)
    return csv_io.read_categories(spark, src)


def q_explode_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_baskets(proxy_baskets(spark, sf_dir))


def q_parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = proxy_baskets(spark, sf_dir)
    return parse_dates(lines.withColumn("fecha_txt", F.col("fecha"))).select("fecha_txt", "fecha")


def q_category_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe_product_category(proxy_product_category(spark, sf_dir))


def q_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enriched_via_baskets(spark, sf_dir)


def q_enriched_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = scratch_path(spark, "enriched")
    write_enriched(enriched_via_baskets(spark, sf_dir), table)
    return (
        read_enriched(spark, table)
        .groupBy("sucursal_id")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("cantidad").cast("bigint").alias("n_units"))
    )


# ---------------------------------------------------------------- KPIs


def q_visits(spark, sf_dir):
    return visits_of(enriched_from_tables(spark, sf_dir))


def q_total_units(spark, sf_dir):
    return kpis.total_units(enriched_from_tables(spark, sf_dir))


def q_total_visits(spark, sf_dir):
    return kpis.total_visits(visits_of(enriched_from_tables(spark, sf_dir)))


def q_unique_counts(spark, sf_dir):
    return kpis.unique_counts(enriched_from_tables(spark, sf_dir))


def q_top_products(spark, sf_dir):
    return kpis.top_products(enriched_from_tables(spark, sf_dir))


def q_top_customers(spark, sf_dir):
    return kpis.top_customers(visits_of(enriched_from_tables(spark, sf_dir)))


def q_daily_visits(spark, sf_dir):
    return kpis.daily_visits(visits_of(enriched_from_tables(spark, sf_dir)))


def q_peak_days(spark, sf_dir):
    return kpis.peak_days(visits_of(enriched_from_tables(spark, sf_dir)))


def q_category_share(spark, sf_dir):
    return categories.category_share(enriched_from_tables(spark, sf_dir))


def q_category_pie(spark, sf_dir):
    return categories.category_pie(categories.category_share(enriched_from_tables(spark, sf_dir)))


def q_rolling_7d(spark, sf_dir):
    return series.rolling_7d(kpis.daily_counts(visits_of(enriched_from_tables(spark, sf_dir))))


def q_customer_units(spark, sf_dir):
    return customers.customer_units(enriched_from_tables(spark, sf_dir))


def q_customer_features(spark, sf_dir):
    e = enriched_from_tables(spark, sf_dir)
    return customers.customer_features(e)


def q_customer_corr(spark, sf_dir):
    e = enriched_from_tables(spark, sf_dir)
    return customers.correlation_matrix(customers.customer_features(e))


def q_customer_box(spark, sf_dir):
    return customers.box_stats(customers.customer_units(enriched_from_tables(spark, sf_dir)))


def q_customer_outliers(spark, sf_dir):
    return customers.outliers(customers.customer_units(enriched_from_tables(spark, sf_dir)))


def q_customer_segments(spark, sf_dir):
    """Every customer's segment and the distance to its centre."""
    found = segment_customers(customers.customer_features(enriched_from_tables(spark, sf_dir)))
    distance = F.sqrt(F.aggregate(F.zip_with("scaled", "centre", lambda x, c: F.pow(x - c, 2)), F.lit(0.0), lambda a, x: a + x))
    return found.assigned.join(found.segments.select("segment", "centre"), "segment").select(
        "cliente_id", *customers.FEATURES, "segment", F.round(distance, 6).alias("distance")
    )


def q_product_rules(spark, sf_dir):
    """What is bought together in at least two visits, of all visits."""
    rules = product_rules(visit_baskets(enriched_from_tables(spark, sf_dir)), min_count=2)
    return rules.select("producto_id", "recomendado", "n_visitas", *(F.round(c, 9).alias(c) for c in ("soporte", "confianza", "lift")))


def q_kpi_bundle(spark, sf_dir):
    return kpi_bundle(enriched_from_tables(spark, sf_dir))


def all_marts(spark: SparkSession, root: str) -> DataFrame:
    """Every row of every mart as (mart, entry): the columns in order of their names, separated by ``|``."""

    def rows(name: str) -> DataFrame:
        mart = read_mart(spark, f"{root}/{name}")
        text = [F.coalesce(_as_text(mart, c), F.lit("null")) for c in sorted(mart.columns)]
        return mart.select(F.lit(name).alias("mart"), F.concat_ws("|", *text).alias("entry"))

    return reduce(DataFrame.union, [rows(name) for name in MART_NAMES])


def _as_text(mart: DataFrame, column: str):
    if mart.schema[column].dataType.typeName() == "double":
        return F.format_string("%.6f", column)
    return F.col(column).cast("string")


def q_kpi_mart_roundtrip(spark, sf_dir):
    """Fact -> versioned table -> every mart, written and read back."""
    root, table = scratch_path(spark, "marts"), scratch_path(spark, "enriched")
    load(spark, table, enriched_from_tables(spark, sf_dir))
    refresh_marts(spark, table, root)
    return all_marts(spark, root)


def q_kpi_partials_roundtrip(spark, sf_dir):
    """Fact -> versioned table -> partials -> every mart from the partials, written and read back."""
    table, parts, root = (scratch_path(spark, n) for n in ("enriched", "partials", "marts"))
    load(spark, table, enriched_from_tables(spark, sf_dir))
    refresh_marts(spark, table, root, parts)
    return all_marts(spark, root)


def q_unique_counts_partials(spark, sf_dir):
    """Distinct customers and products from the mergeable bitmaps of the partials."""
    table, parts = scratch_path(spark, "enriched"), scratch_path(spark, "partials")
    load(spark, table, enriched_from_tables(spark, sf_dir))
    refresh_partials(spark, table, parts)
    return unique_counts_from_partials(read_partials(spark, parts)["distincts"])


# ---------------------------------------------------------------- files, manifests, streaming


def q_source_manifest(spark, sf_dir):
    """Bytes of every branch's files (the other manifest columns depend on paths and times)."""
    src = scratch_path(spark, "baskets")
    csv_io.write_baskets(proxy_baskets(spark, sf_dir), src)
    return branch_manifest(source_manifest(spark, src)).select("branch", "size")


def _write_arrivals(spark: SparkSession, sf_dir: str, src: str) -> tuple[str, str]:
    """Every receipt line as branch files in two folders: all years but the newest, and the newest."""
    lines = _arrivals(spark, sf_dir)
    newest = read_table(spark, sf_dir, "orders").agg(F.max(F.year("o_orderdate"))).scalar()
    old, new = f"{src}/arrival=old", f"{src}/arrival=new"
    csv_io.write_baskets(lines.filter(F.col("arrival") < newest), old)
    csv_io.write_baskets(lines.filter(F.col("arrival") >= newest), new)
    return old, new


def q_manifest_diff(spark, sf_dir):
    """Receipts arrive by year: the manifest before the newest year's files
    land (saved as a table) is compared with the manifest after."""
    src = scratch_path(spark, "arrivals")
    state = scratch_path(spark, "manifest_state")
    lines = _arrivals(spark, sf_dir)
    newest = read_table(spark, sf_dir, "orders").agg(F.max(F.year("o_orderdate"))).scalar()
    csv_io.write_baskets(lines.filter(F.col("arrival") < newest), f"{src}/arrival=old")
    branch_manifest(source_manifest(spark, src)).write.parquet(state)
    csv_io.write_baskets(lines.filter(F.col("arrival") >= newest), f"{src}/arrival=new")
    diff = manifest_diff(spark.read.parquet(state), branch_manifest(source_manifest(spark, src)))
    return diff.select("branch", "change")


def _dimension_files(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    bridge, names = scratch_path(spark, "product_category"), scratch_path(spark, "categories")
    csv_io.write_product_category(proxy_product_category(spark, sf_dir), bridge)
    csv_io.write_categories(proxy_categories(spark, sf_dir), names)
    return bridge, names


def _units_by_branch(spark: SparkSession, table: str) -> DataFrame:
    return (
        read_enriched(spark, table)
        .groupBy("sucursal_id")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.sum("cantidad").cast("bigint").alias("n_units"),
            F.count("nombre_categoria").alias("n_named"),
        )
    )


def q_etl_full(spark, sf_dir):
    """The ETL job over the files of all branches, into a new table."""
    src, table = scratch_path(spark, "etl_src"), scratch_path(spark, "etl_table")
    csv_io.write_baskets(proxy_baskets(spark, sf_dir), src)
    run_etl(spark, src, *_dimension_files(spark, sf_dir), table)
    return _units_by_branch(spark, table)


def q_etl_incremental(spark, sf_dir):
    """The ETL job run twice on one source: the newest year first, then the older years' files are there and its own are
    gone (every branch with both is modified).  The table must hold the older years' lines alone."""
    src, table = (scratch_path(spark, f"etl_{n}") for n in ("src", "table"))
    old, new = _write_arrivals(spark, sf_dir, src)
    dims = _dimension_files(spark, sf_dir)
    run_etl(spark, new, *dims, table, origin="receipts")
    run_etl(spark, old, *dims, table, origin="receipts")
    return _units_by_branch(spark, table)


def q_batch_then_stream(spark, sf_dir):
    """Older years by the batch job, the newest by a stream into the same table: their lines add up."""
    src, table, checkpoint = (scratch_path(spark, f"mixed_{n}") for n in ("src", "table", "checkpoint"))
    old, new = _write_arrivals(spark, sf_dir, src)
    run_etl(spark, old, *_dimension_files(spark, sf_dir), table)
    ingest_stream(
        spark, f"{new}/*/", proxy_product_category(spark, sf_dir), proxy_categories(spark, sf_dir), table, checkpoint
    )
    return _units_by_branch(spark, table)


def q_stream_then_batch(spark, sf_dir):
    """The newest year by a stream, then a first batch run over the older years into the same table: their lines add up."""
    src, table, checkpoint = (scratch_path(spark, f"mixed_{n}") for n in ("src", "table", "checkpoint"))
    old, new = _write_arrivals(spark, sf_dir, src)
    ingest_stream(
        spark, f"{new}/*/", proxy_product_category(spark, sf_dir), proxy_categories(spark, sf_dir), table, checkpoint
    )
    run_etl(spark, old, *_dimension_files(spark, sf_dir), table)
    return _units_by_branch(spark, table)


def _write_dated(lines: DataFrame, path: str) -> None:
    """Receipt lines as one folder per year, whatever branches they belong to: the files name no branch."""
    (
        lines.select(*RAW_BASKET_SCHEMA.fieldNames(), F.substring("fecha", 1, 4).alias("year"))
        .hint("rebalance", "year")
        .write.mode("overwrite")
        .partitionBy("year")
        .option("sep", csv_io.SEPARATOR)
        .csv(path)
    )


def q_etl_partials_incremental(spark, sf_dir):
    """ETL, partials and marts three times as files come, change and go; every mart must equal that of what is left.

    Branch files of the years but the newest; then the newest year's files land, which name no branch and mix all of them;
    then the branch files go but for those of the first ten branches, and the newest year's are rewritten without its
    second half.  Only the files that changed are read and folded.
    """
    src, table, parts, root, receipts = (scratch_path(spark, f"partials_{n}") for n in ("src", "table", "parts", "marts", "receipts"))
    arrivals, dims = _arrivals(spark, sf_dir), _dimension_files(spark, sf_dir)
    arrivals.write.parquet(receipts)  # built once: four sets of files are cut from it
    lines = spark.read.schema(arrivals.schema).parquet(receipts)
    newest = read_table(spark, sf_dir, "orders").agg(F.max(F.year("o_orderdate"))).scalar()
    older, latest = lines.filter(F.col("arrival") < newest), lines.filter(F.col("arrival") >= newest)
    first_ten = F.col("sucursal_id") < 10
    csv_io.write_baskets(older.filter(first_ten), f"{src}/kept")
    csv_io.write_baskets(older.filter(~first_ten), f"{src}/going")

    def bring_up() -> None:
        run_etl(spark, src, *dims, table)
        refresh_marts(spark, table, root, parts)

    bring_up()
    _write_dated(latest, f"{src}/dated")
    bring_up()
    older.limit(0).select(*RAW_BASKET_SCHEMA.fieldNames()).write.mode("overwrite").csv(f"{src}/going")
    _write_dated(latest.filter(F.month(F.to_date("fecha")) <= 6), f"{src}/dated")
    bring_up()
    return all_marts(spark, root)


def q_etl_rejects(spark, sf_dir):
    """Rejected lines and units by branch of file after a mend: every fifth day's lines lack their last field at first,
    then the files of branches below 10 are mended and those above 20 deleted."""
    src, table = scratch_path(spark, "rejects_src"), scratch_path(spark, "rejects_table")
    lines, dims = proxy_baskets(spark, sf_dir), _dimension_files(spark, sf_dir)
    spoilt = F.dayofmonth(F.to_date("fecha")) % 5 == 0
    group = F.when(F.col("sucursal_id") < 10, "low").when(F.col("sucursal_id") <= 20, "middle").otherwise("high")

    def write(df: DataFrame, name: str, spoil: bool) -> None:
        whole = F.concat_ws("|", *RAW_BASKET_SCHEMA.fieldNames())
        short = F.concat_ws("|", *RAW_BASKET_SCHEMA.fieldNames()[:3])
        text = df.filter(group == name).select(F.when(spoilt & F.lit(spoil), short).otherwise(whole).alias("value"))
        text.write.mode("overwrite").option("compression", "none").format("text").save(f"{src}/{name}")

    for name in ("low", "middle", "high"):
        write(lines, name, True)
    pattern = {"pattern": "*.txt"}
    run_etl(spark, src, *dims, table, **pattern)
    write(lines, "low", False)
    write(lines.limit(0), "high", False)
    run_etl(spark, src, *dims, table, **pattern)
    pinned = snapshot(spark, table)
    rejected = pinned.rejects().groupBy("sucursal_id").agg(F.count(F.lit(1)).alias("n_rejects"))
    units = pinned.fact().groupBy("sucursal_id").agg(F.count(F.lit(1)).alias("n_units"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return units.join(rejected, "sucursal_id", "full").select("sucursal_id", zero("n_units"), zero("n_rejects"))


def q_stream_ingest(spark, sf_dir):
    """Receipt files (one folder per arrival year and branch) drained by a
    Structured Streaming query in several micro-batches; returns units per
    branch of the resulting table (must equal the batch ETL)."""
    src = scratch_path(spark, "stream_src")
    table = scratch_path(spark, "stream_table")
    ckpt = scratch_path(spark, "stream_ckpt")
    lines = _arrivals(spark, sf_dir)
    (
        lines.withColumn("branch", F.col("sucursal_id"))
        .select(*RAW_BASKET_SCHEMA.fieldNames(), "arrival", "branch")
        .hint("rebalance", "arrival", "branch")
        .write.partitionBy("arrival", "branch")
        .option("sep", csv_io.SEPARATOR)
        .csv(src)
    )
    ingest_stream(
        spark,
        f"{src}/*/*/",
        proxy_product_category(spark, sf_dir),
        proxy_categories(spark, sf_dir),
        table,
        ckpt,
        max_files_per_trigger=64,
    )
    return read_enriched(spark, table).groupBy("sucursal_id").agg(F.count(F.lit(1)).alias("n_units"))


# ---------------------------------------------------------------- job log reports


def q_latest_per_key(spark, sf_dir):
    return jobs.latest_per_key(read_table(spark, sf_dir, "events"), "event_type", "event_id")


def q_recent_n(spark, sf_dir):
    return jobs.recent_n(read_table(spark, sf_dir, "events"), "event_id", 20)


QUERIES: dict[str, Query] = {
    "ingest_baskets": q_ingest_baskets,
    "ingest_product_category": q_ingest_product_category,
    "ingest_categories": q_ingest_categories,
    "explode_baskets": q_explode_baskets,
    "parse_dates": q_parse_dates,
    "category_dedupe": q_category_dedupe,
    "enrich": q_enrich,
    "enriched_roundtrip": q_enriched_roundtrip,
    "visits": q_visits,
    "total_units": q_total_units,
    "total_visits": q_total_visits,
    "unique_counts": q_unique_counts,
    "top_products": q_top_products,
    "top_customers": q_top_customers,
    "daily_visits": q_daily_visits,
    "peak_days": q_peak_days,
    "category_share": q_category_share,
    "category_pie": q_category_pie,
    "rolling_7d": q_rolling_7d,
    "customer_units": q_customer_units,
    "customer_features": q_customer_features,
    "customer_corr": q_customer_corr,
    "customer_box": q_customer_box,
    "customer_outliers": q_customer_outliers,
    "customer_segments": q_customer_segments,
    "product_rules": q_product_rules,
    "kpi_bundle": q_kpi_bundle,
    "kpi_mart_roundtrip": q_kpi_mart_roundtrip,
    "kpi_partials_roundtrip": q_kpi_partials_roundtrip,
    "unique_counts_partials": q_unique_counts_partials,
    "source_manifest": q_source_manifest,
    "manifest_diff": q_manifest_diff,
    "etl_full": q_etl_full,
    "etl_incremental": q_etl_incremental,
    "etl_partials_incremental": q_etl_partials_incremental,
    "etl_rejects": q_etl_rejects,
    "batch_then_stream": q_batch_then_stream,
    "stream_then_batch": q_stream_then_batch,
    "stream_ingest": q_stream_ingest,
    "latest_per_key": q_latest_per_key,
    "recent_n": q_recent_n,
}
