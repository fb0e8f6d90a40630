"""The proxy measurements published with the fixtures, reproduced by our operators."""

import pytest
from pyspark.sql import functions as F

from basketry.operators import categories, customers, kpis
from basketry.operators.visits import visits
from basketry.plans.catalog import enriched_from_tables
from basketry.sources.tables import proxy_product_category

# Measured on the driver's tables (sf0.001, sf0.01).
EXPECTED = {
    "/root/testdata/sf0.001": dict(units=6000, products=200, uncategorised=2544, multi=52, visits=1472,
                                   days=1084, max_day=5, customers=150, min_units=6, max_units=84, kept=12, otros=13),
    "/root/testdata/sf0.01": dict(units=60000, products=2000, uncategorised=30351, multi=394, visits=14711,
                                  days=2399, max_day=16, customers=1500, min_units=3, max_units=93, kept=10, otros=15),
}


@pytest.mark.parametrize("sf_dir", list(EXPECTED))
def test_measurements(spark, sf_dir):
    e = EXPECTED[sf_dir]
    f = enriched_from_tables(spark, sf_dir)
    assert f.count() == e["units"]
    assert f.select("producto_id").distinct().count() == e["products"]
    assert f.filter(F.col("categoria_id").isNull()).count() == e["uncategorised"]
    multi = proxy_product_category(spark, sf_dir).groupBy("producto_id").count().filter("count > 1").count()
    assert multi == e["multi"]
    v = visits(f)
    assert v.count() == e["visits"]
    daily = kpis.daily_counts(v)
    assert daily.count() == e["days"]
    assert daily.agg(F.max("n_transacciones")).first()[0] == e["max_day"]
    units = customers.customer_units(f)
    row = units.agg(F.count("*"), F.min("total_cantidad"), F.max("total_cantidad")).first()
    assert tuple(row) == (e["customers"], e["min_units"], e["max_units"])
    share = categories.category_share(f)
    small = share.filter(F.col("pct") < 3.0).count()
    assert (share.count() - small, small) == (e["kept"], e["otros"])


def test_matrix_invariants(spark):
    f = enriched_from_tables(spark, "/root/testdata/sf0.01")
    m = {(r.var_x, r.var_y): r.r for r in customers.correlation_matrix(customers.customer_features(f)).collect()}
    for (x, y), r in m.items():
        assert r is None or -1.0 <= r <= 1.0
        assert m[(y, x)] == r
        if x == y:
            assert r == 1.0
