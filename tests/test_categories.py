"""Category share and the small-share bucket."""

import datetime as dt

import pytest

from basketry.operators.categories import category_pie, category_share
from basketry.schemas import ENRICHED_SCHEMA

D = dt.date(2013, 1, 1)


def _fact(spark, counts, uncategorised=0):
    rows = []
    for i, (name, n) in enumerate(counts.items()):
        rows += [(D, 1, 1, 100 + i, 1, i, name)] * n
    rows += [(D, 1, 1, 999, 1, None, None)] * uncategorised
    return spark.createDataFrame(rows, ENRICHED_SCHEMA)


def test_share_uses_categorised_denominator(spark):
    s = category_share(_fact(spark, {"A": 60, "B": 30, "C": 10}, uncategorised=100)).collect()
    assert [(r.nombre_categoria, r.total_cantidad, r.n_productos, r.pct) for r in s] == [
        ("A", 60, 1, 60.0), ("B", 30, 1, 30.0), ("C", 10, 1, 10.0)
    ]


def test_share_rounding_half_up(spark):
    # 1/8 = 12.5 %, 1/3 = 33.33 %
    s = {r.nombre_categoria: r.pct for r in category_share(_fact(spark, {"A": 1, "B": 7})).collect()}
    assert s == {"A": 12.5, "B": 87.5}
    s = {r.nombre_categoria: r.pct for r in category_share(_fact(spark, {"A": 1, "B": 2})).collect()}
    assert s == {"A": 33.33, "B": 66.67}


def test_pie_merges_small_shares(spark):
    counts = {"A": 500, "B": 400, "C": 29, "D": 20, "E": 51}
    pie = category_pie(category_share(_fact(spark, counts))).collect()
    got = [(r.nombre_categoria, r.total_cantidad, r.pct) for r in pie]
    assert got[:2] == [("A", 500, 50.0), ("B", 400, 40.0)]
    assert ("Otros", 49, pytest.approx(4.9)) in got
    assert ("E", 51, 5.1) in got
    assert sum(r.total_cantidad for r in pie) == 1000


def test_pie_without_small_shares_has_no_bucket(spark):
    pie = category_pie(category_share(_fact(spark, {"A": 50, "B": 50}))).collect()
    assert [r.nombre_categoria for r in pie] == ["A", "B"]


def test_no_categorised_rows(spark):
    f = _fact(spark, {}, uncategorised=5)
    assert category_share(f).count() == 0
    assert category_pie(category_share(f)).count() == 0


def test_pct_all_counts_uncategorised(spark):
    s = category_share(_fact(spark, {"A": 60, "B": 40}, uncategorised=100), with_pct_all=True).collect()
    assert [(r.nombre_categoria, r.pct, r.pct_all) for r in s] == [("A", 60.0, 30.0), ("B", 40.0, 20.0)]
