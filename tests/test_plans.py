"""Plan-shape checks: pruning, pushdown, single scans, reuse, broadcast policy, skew split."""

import datetime as dt
import os
import re

import pytest

from basketry.operators import categories, customers, kpis
from basketry.operators.etl import enrich_with_categories
from basketry.plans.catalog import enriched_from_tables
from basketry.plans.kpi_job import kpi_bundle
from basketry.schemas import ENRICHED_SCHEMA
from basketry.sources.parquet import read_enriched, write_enriched
from tests.conftest import SF_SMALL


def scans(p):
    return len(re.findall(r"^\(\d+\) Scan parquet", p, re.M))


def plan(df, capsys):
    capsys.readouterr()
    df.explain("formatted")
    return capsys.readouterr().out


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "fact")
    write_enriched(enriched_from_tables(spark, SF_SMALL), path)
    return path


def test_kpi_scan_reads_only_needed_columns(spark, table, capsys):
    p = plan(kpis.top_products(read_enriched(spark, table)), capsys)
    assert "ReadSchema: struct<producto_id:int,cantidad:int>" in p
    assert "TakeOrderedAndProject" in p


def test_null_category_filter_pushed_to_parquet(spark, table, capsys):
    p = plan(categories.category_share(read_enriched(spark, table)), capsys)
    assert "PushedFilters: [IsNotNull(nombre_categoria)]" in p
    assert scans(p) == 1  # denominator from the aggregated rows, no second scan


def test_single_scan_box(spark, table, capsys):
    f = read_enriched(spark, table)
    assert scans(plan(customers.box_stats(customers.customer_units(f)), capsys)) == 1


def test_distinct_counts_expand_no_row(spark, table, capsys):
    f = read_enriched(spark, table)
    for df in (kpi_bundle(f), customers.customer_features(f)):
        p = plan(df, capsys)
        assert "Expand" not in p
        assert scans(p) == 2  # the fold of units, and the visits


def test_quantiles_sort_no_values_in_one_task(spark, table, capsys):
    """Fences are scalars: one global aggregate and one filter, no window and no join over the values."""
    units = customers.customer_units(read_enriched(spark, table))
    p = plan(customers.outliers(units), capsys)
    assert "Window" not in p and "Join" not in p and "SinglePartition" not in p
    p = plan(customers.box_stats(units), capsys)
    assert "Window" not in p and "Join" not in p and "Sort" not in p


def test_unique_counts_expand_no_row(spark, table, capsys):
    assert "Expand" not in plan(kpis.unique_counts(read_enriched(spark, table)), capsys)


def test_partition_pruning_by_branch(spark, table, capsys):
    p = plan(kpis.total_units(read_enriched(spark, table, branches=[3])), capsys)
    assert "PartitionFilters: [isnotnull(sucursal_id" in p and "sucursal_id" in p


def _join_inputs(spark):
    fact = spark.createDataFrame([(dt.date(2013, 1, 1), 1, 1, p, 1) for p in range(200)],
                                 "fecha date, sucursal_id int, cliente_id int, producto_id int, cantidad int")
    pc = spark.createDataFrame([(p, p % 7) for p in range(150)], "producto_id int, categoria_id int")
    cats = spark.createDataFrame([(c, f"c{c}") for c in range(7)], "categoria_id int, nombre_categoria string")
    return fact, pc, cats


def test_fact_is_joined_once(spark, capsys):
    """The names join the bridge, not the fact, and nothing is forced into a broadcast."""
    from basketry.operators.etl import enrich_with_products, product_categories

    fact, pc, cats = _join_inputs(spark)
    products = product_categories(pc, cats)
    logical = enrich_with_products(fact, products)._jdf.queryExecution().optimizedPlan().toString()
    assert logical.count("Join LeftOuter") == 2 and "ResolvedHint" not in logical and "strategy=broadcast" not in logical
    assert plan(enrich_with_categories(fact, pc, cats), capsys).count("LeftOuter") >= 2


def test_latest_per_key_does_not_sort(spark, capsys):
    from basketry.operators.jobs import latest_per_key

    events = spark.createDataFrame([(i, i % 3, "x") for i in range(50)], "event_id long, k int, v string")
    assert "SortAggregate" not in plan(latest_per_key(events, "k", "event_id"), capsys)
    assert sorted(r.event_id for r in latest_per_key(events, "k", "event_id").collect()) == [47, 48, 49]


def test_hot_branch_is_split_over_files(spark, tmp_path):
    """A branch with a third of the rows is spread by the rebalance write, not one task."""
    rows = []
    for i in range(3000):
        branch = 1 if i % 3 == 0 else 2 + i % 20
        rows.append((dt.date(2013, 1, 1 + i % 28), branch, i, i % 97, 1, None, None))
    df = spark.createDataFrame(rows, ENRICHED_SCHEMA)
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2k")
    try:
        write_enriched(df, str(tmp_path / "t"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    from basketry.sources.snapshots import load

    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2k")
    try:
        load(spark, str(tmp_path / "v"), df)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    assert len([f for f in os.listdir(tmp_path / "v" / "data" / "version=1" / "sucursal_id=1") if f.endswith(".parquet")]) > 1
    hot = [f for f in os.listdir(tmp_path / "t" / "sucursal_id=1" / "lote=0") if f.endswith(".parquet")]
    assert len(hot) > 1
    assert read_enriched(spark, str(tmp_path / "t")).count() == 3000
