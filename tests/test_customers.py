"""Customer features, correlation, box statistics, outliers."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from basketry.operators import customers
from basketry.operators.visits import visits
from basketry.plans.catalog import enriched_from_tables
from basketry.schemas import ENRICHED_SCHEMA
from tests.conftest import SF_SMALL


def test_features_against_brute_force(spark):
    f = enriched_from_tables(spark, SF_SMALL)
    got = customers.customer_features(f).toPandas().set_index("cliente_id").sort_index()
    pdf = f.toPandas()
    exp = pd.DataFrame(
        {
            "frecuencia": pdf.drop_duplicates(["cliente_id", "fecha", "sucursal_id"]).groupby("cliente_id").size(),
            "total_cantidad": pdf.groupby("cliente_id").cantidad.sum(),
            "productos_distintos": pdf.groupby("cliente_id").producto_id.nunique(),
            "categorias_distintas": pdf.groupby("cliente_id").categoria_id.nunique(),
        }
    ).sort_index()
    for c in exp.columns:
        assert (got[c].astype(int).values == exp[c].astype(int).values).all(), c


def test_correlation_against_pandas(spark):
    f = enriched_from_tables(spark, SF_SMALL)
    feats = customers.customer_features(f)
    got = {(r.var_x, r.var_y): r.r for r in customers.correlation_matrix(feats).collect()}
    exp = feats.toPandas().drop(columns="cliente_id").corr()
    from basketry.functions.text import FEATURE_LABELS as L

    assert len(got) == 16
    for a in exp.columns:
        for b in exp.columns:
            assert got[(L[a], L[b])] == pytest.approx(round(exp.loc[a, b], 6), abs=1e-6)
            assert got[(L[a], L[b])] == got[(L[b], L[a])]


def test_constant_feature_gives_null(spark):
    feats = spark.createDataFrame(
        [(1, 1, 5, 2, 1), (2, 1, 7, 3, 2), (3, 1, 9, 1, 3)],
        "cliente_id int, frecuencia long, total_cantidad long, productos_distintos long, categorias_distintas long",
    )
    got = {(r.var_x, r.var_y): r.r for r in customers.correlation_matrix(feats).collect()}
    assert got[("Frecuencia", "Frecuencia")] is None
    assert got[("Frecuencia", "Total cantidad")] is None
    assert got[("Total cantidad", "Total cantidad")] == 1.0


def test_single_customer(spark):
    feats = spark.createDataFrame([(1, 1, 5, 2, 1)], "cliente_id int, frecuencia long, total_cantidad long, productos_distintos long, categorias_distintas long")
    assert all(r.r is None for r in customers.correlation_matrix(feats).collect())


def test_box_and_outliers_against_numpy(spark):
    vals = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 40, -20]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "cliente_id int, total_cantidad long")
    b = customers.box_stats(df).first()
    q1, med, q3 = np.percentile(vals, [25, 50, 75])  # linear interpolation (R-7)
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    inside = [v for v in vals if lo <= v <= hi]
    assert (b.q1, b.mediana, b.q3) == pytest.approx((q1, med, q3))
    assert b.media == pytest.approx(np.mean(vals))
    assert (b.bigote_inf, b.bigote_sup) == (min(inside), max(inside))
    assert b.n_outliers == len(vals) - len(inside)
    out = sorted(r.total_cantidad for r in customers.outliers(df).collect())
    assert out == sorted(v for v in vals if v < lo or v > hi)


@pytest.mark.parametrize("seed,n", [(1, 1), (2, 2), (3, 5), (4, 997), (5, 1_000_000)])
def test_exact_quantiles_against_numpy(spark, seed, n):
    """Ties, negative values, nulls, heavy tails, and a million distinct values over many partitions."""
    rng = np.random.default_rng(seed)
    if n < 1000:
        vals = np.concatenate([rng.integers(-5, 5, n), rng.integers(-(10**12), 10**12, n // 2)])
        df = spark.createDataFrame([(int(v),) for v in vals] + [(None,)] * 3, "x long")
    else:
        vals = (np.arange(n, dtype=np.int64) * 7919) % 1_000_003
        df = spark.range(n).selectExpr("(id * 7919) % 1000003 as x")
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    assert customers.exact_quantiles(df, "x", shares) == pytest.approx(list(np.quantile(vals, shares)), rel=1e-12)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([], "cliente_id int, total_cantidad long")
    assert customers.exact_quantiles(df, "total_cantidad", [0.5]) == [None]
    assert tuple(customers.box_stats(df).first()) == (None, None, None, None, None, None, 0)
    assert customers.outliers(df).count() == 0


def test_product_with_two_categories(spark):
    """A running stream keeps its dimensions, so a product can have two categories in the fact: it is one product, two categories."""
    from basketry.plans.kpi_job import kpi_bundle

    D = dt.date(2013, 1, 1)
    rows = [(D, 1, 1, 7, 1, 1, "Uno"), (D, 1, 1, 7, 1, 2, "Dos"), (D, 1, 1, 7, 1, None, None), (D, 1, 2, 8, 1, 2, "Dos")]
    f = spark.createDataFrame(rows, ENRICHED_SCHEMA)
    assert {r.kpi: r.value for r in kpi_bundle(f).collect()} == {
        "total_unidades": 4, "productos_unicos": 2, "categorias_con_nombre": 2, "unidades_sin_categoria": 1,
        "productos_sin_categoria": 1, "total_visitas": 2, "clientes_unicos": 2,
    }
    got = {r.cliente_id: (r.total_cantidad, r.productos_distintos, r.categorias_distintas) for r in customers.customer_features(f).collect()}
    assert got == {1: (3, 1, 2), 2: (1, 1, 1)}


def test_customer_units(spark):
    D = dt.date(2013, 1, 1)
    f = spark.createDataFrame([(D, 1, 1, 1, 1, None, None)] * 3 + [(D, 1, 2, 1, 1, None, None)], ENRICHED_SCHEMA)
    assert {r.cliente_id: r.total_cantidad for r in customers.customer_units(f).collect()} == {1: 3, 2: 1}
