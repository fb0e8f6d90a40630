"""KPI job: every mart written, read back equal to the direct computation."""

from basketry.operators import categories, customers, kpis
from basketry.operators.visits import visits
from basketry.plans.catalog import enriched_from_tables
from basketry.plans.kpi_job import kpi_bundle, run_kpis
from basketry.sources.parquet import read_mart
from tests.conftest import SF_SMALL


def _rows(df):
    return sorted(str(tuple(r)) for r in df.collect())


def test_marts_roundtrip(spark, tmp_path):
    f = enriched_from_tables(spark, SF_SMALL)
    root = str(tmp_path / "marts")
    names = run_kpis(f, root)
    assert set(names) == {
        "kpis", "top_products", "top_customers", "peak_days", "category_share", "category_pie",
        "daily_series", "customer_box", "customer_outliers", "customer_corr",
    }
    v = visits(f)
    assert _rows(read_mart(spark, f"{root}/kpis")) == _rows(kpi_bundle(f))
    assert _rows(read_mart(spark, f"{root}/top_products")) == _rows(kpis.top_products(f))
    assert _rows(read_mart(spark, f"{root}/category_share")) == _rows(categories.category_share(f))
    assert _rows(read_mart(spark, f"{root}/customer_box")) == _rows(customers.box_stats(customers.customer_units(f)))


def test_bundle_invariants(spark):
    f = enriched_from_tables(spark, SF_SMALL)
    k = {r.kpi: r.value for r in kpi_bundle(f).collect()}
    assert k["total_unidades"] == f.count()  # sum(cantidad) = rows
    assert k["total_visitas"] == visits(f).count()
    daily = kpis.daily_counts(visits(f))
    assert daily.agg({"n_transacciones": "sum"}).first()[0] == k["total_visitas"]  # Σ daily = total
    share = categories.category_share(f)
    named_units = share.agg({"total_cantidad": "sum"}).first()[0]
    assert named_units + k["unidades_sin_categoria"] == k["total_unidades"]
    unmapped = f.filter("categoria_id is null").select("producto_id").distinct().count()
    assert k["productos_sin_categoria"] == unmapped
    pie = categories.category_pie(share)
    assert pie.agg({"total_cantidad": "sum"}).first()[0] == named_units


def test_kpi_job_on_empty_fact(spark, tmp_path):
    from basketry.schemas import ENRICHED_SCHEMA

    empty = spark.createDataFrame([], ENRICHED_SCHEMA)
    root = str(tmp_path / "marts")
    run_kpis(empty, root)
    k = {r.kpi: r.value for r in read_mart(spark, f"{root}/kpis").collect()}
    assert k["total_unidades"] == 0 and k["total_visitas"] == 0
    box = read_mart(spark, f"{root}/customer_box").collect()
    assert len(box) == 1 and box[0].q1 is None and box[0].n_outliers == 0
    assert read_mart(spark, f"{root}/top_products").count() == 0
    assert all(r.r is None for r in read_mart(spark, f"{root}/customer_corr").collect())



def test_mart_views(spark, tmp_path):
    from basketry.plans.kpi_job import MART_NAMES, register_mart_views

    f = enriched_from_tables(spark, SF_SMALL)
    root = str(tmp_path / "marts")
    assert sorted(run_kpis(f, root)) == sorted(MART_NAMES)
    views = register_mart_views(spark, root)
    assert "kpi_top_products" in views
    top = spark.sql("select producto_id from kpi_top_products order by total_cantidad desc, producto_id").collect()
    assert [r.producto_id for r in top] == [r.producto_id for r in kpis.top_products(f).collect()]
