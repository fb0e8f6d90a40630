"""Totals, visits, top-k, daily series and peak days."""

import datetime as dt

from basketry.operators import kpis
from basketry.operators.visits import visits
from basketry.schemas import ENRICHED_SCHEMA


def _fact(spark, rows):
    return spark.createDataFrame(rows, ENRICHED_SCHEMA)


D1, D2, D3 = dt.date(2013, 1, 6), dt.date(2013, 1, 7), dt.date(2013, 1, 8)  # Sunday, Monday, Tuesday


def test_totals_and_visits(spark):
    f = _fact(spark, [(D1, 1, 10, 5, 1, None, None), (D1, 1, 10, 5, 1, None, None), (D1, 2, 10, 6, 1, 1, "A"), (D2, 1, 11, 5, 1, None, None)])
    assert kpis.total_units(f).first().value == 4
    v = visits(f)
    assert v.count() == 3
    assert kpis.total_visits(v).first().value == 3
    u = kpis.unique_counts(f).first()
    assert (u.n_clientes, u.n_productos) == (2, 2)


def test_empty_input_gives_zero_not_null(spark):
    f = _fact(spark, [])
    assert kpis.total_units(f).first().value == 0
    assert kpis.total_visits(visits(f)).first().value == 0
    assert kpis.top_products(f).count() == 0


def test_top_products_ties_break_by_id(spark):
    rows = []
    for p in range(1, 13):  # products 1..12, each sold 5 units except 11 and 12 sell 9
        n = 9 if p > 10 else 5
        rows += [(D1, 1, 1, p, 1, None, None)] * n
    top = kpis.top_products(_fact(spark, rows)).collect()
    assert [r.producto_id for r in top] == [11, 12, 1, 2, 3, 4, 5, 6, 7, 8]
    assert top[0].label == "Producto 11" and top[0].texto == "9"


def test_thousands_text(spark):
    rows = [(D1, 1, 1, 1, 1, None, None)] * 1234
    assert kpis.top_products(_fact(spark, rows)).first().texto == "1,234"


def test_top_customers_counts_visits_not_units(spark):
    f = _fact(spark, [(D1, 1, 1, 1, 1, None, None)] * 5 + [(D1, 1, 2, 1, 1, None, None), (D2, 1, 2, 1, 1, None, None)])
    top = kpis.top_customers(visits(f)).collect()
    assert [(r.cliente_id, r.n_transacciones, r.label) for r in top] == [(2, 2, "Cliente 2"), (1, 1, "Cliente 1")]


def test_daily_and_peak_days(spark):
    f = _fact(spark, [(D1, 1, 1, 1, 1, None, None), (D1, 1, 2, 1, 1, None, None), (D2, 1, 1, 1, 1, None, None), (D3, 2, 1, 1, 1, None, None), (D3, 2, 2, 1, 1, None, None)])
    v = visits(f)
    daily = [tuple(r) for r in kpis.daily_visits(v).collect()]
    assert daily == [("2013-01-06", 2), ("2013-01-07", 1), ("2013-01-08", 2)]
    peak = kpis.peak_days(v, k=2).collect()
    # top-2 by visits (tie -> earlier date), then re-sorted by date
    assert [(r.fecha, r.dia_semana, r.dia) for r in peak] == [("2013-01-06", 1, "Dom"), ("2013-01-08", 3, "Mar")]
    assert peak[0].hover == "2013-01-06<br>Dom<br>2 transacciones"
