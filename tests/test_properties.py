"""Property tests: operators against plain-Python brute force on random inputs."""

import datetime as dt
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from basketry.operators import categories, customers, series
from basketry.operators.etl import explode_baskets
from basketry.schemas import ENRICHED_SCHEMA

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
INT_MAX = 2**31 - 1

token = st.one_of(
    st.integers(min_value=0, max_value=10**12).map(str),
    st.sampled_from(["a", "-", "7x", "", "+3", "-4", "0008"]),
)
basket = st.lists(token, max_size=8).flatmap(
    lambda toks: st.sampled_from([" ", "  ", "\t", " \t "]).map(lambda sep: sep.join(toks))
).flatmap(lambda b: st.sampled_from(["", " ", "  "]).map(lambda pad: pad + b + pad))


def _python_tokens(raw):
    out = []
    for t in raw.split():
        try:
            v = int(t)
        except ValueError:
            continue
        if -(2**31) <= v <= INT_MAX:
            out.append(v)
    return out


@SETTINGS
@given(st.lists(basket, min_size=1, max_size=6))
def test_explode_matches_python(spark, baskets):
    raw = spark.createDataFrame(
        [("2013-01-01", 1, i, b) for i, b in enumerate(baskets)],
        "fecha string, sucursal_id int, cliente_id int, productos_raw string",
    )
    got = sorted((r.cliente_id, r.producto_id) for r in explode_baskets(raw).collect())
    exp = sorted((i, v) for i, b in enumerate(baskets) for v in _python_tokens(b))
    assert got == exp


def _half_up(x, digits=2):
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), rounding=ROUND_HALF_UP))


@SETTINGS
@given(st.lists(st.integers(min_value=1, max_value=400), min_size=1, max_size=12))
def test_pie_matches_rule(spark, counts):
    rows = []
    for i, n in enumerate(counts):
        rows += [(dt.date(2013, 1, 1), 1, 1, i, 1, i, f"cat{i:02d}")] * n
    share = categories.category_share(spark.createDataFrame(rows, ENRICHED_SCHEMA))
    got = sorted((r.nombre_categoria, r.total_cantidad, r.pct) for r in categories.category_pie(share).collect())
    total = sum(counts)
    pct = {f"cat{i:02d}": _half_up(n / total * 100) for i, n in enumerate(counts)}
    kept = [(k, counts[int(k[3:])], p) for k, p in pct.items() if p >= 3.0]
    small = [k for k, p in pct.items() if p < 3.0]
    if small:
        kept.append(("Otros", sum(counts[int(k[3:])] for k in small), _half_up(sum(pct[k] for k in small))))
    assert len(got) == len(kept)
    for (gn, gt, gp), (en, et, ep) in zip(got, sorted(kept)):
        assert (gn, gt) == (en, et)
        assert abs(gp - ep) < 1e-9


@SETTINGS
@given(st.lists(st.integers(min_value=-50, max_value=500), min_size=1, max_size=40))
def test_box_matches_numpy(spark, vals):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "cliente_id int, total_cantidad long")
    b = customers.box_stats(df).first()
    q1, med, q3 = np.percentile(vals, [25, 50, 75])
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    inside = [v for v in vals if lo <= v <= hi]
    assert np.allclose([b.q1, b.mediana, b.q3, b.media], [q1, med, q3, np.mean(vals)])
    assert (b.bigote_inf, b.bigote_sup, b.n_outliers) == (min(inside), max(inside), len(vals) - len(inside))
    got_out = sorted(r.total_cantidad for r in customers.outliers(df).collect())
    assert got_out == sorted(v for v in vals if v < lo or v > hi)


@SETTINGS
@given(st.lists(st.integers(min_value=0, max_value=1000), min_size=1, max_size=30))
def test_rolling_matches_pandas(spark, values):
    rows = [(dt.date(2013, 1, 1) + dt.timedelta(days=3 * i), v) for i, v in enumerate(values)]
    got = [r.rolling_7d for r in series.rolling_7d(spark.createDataFrame(rows, "fecha date, n_transacciones long")).collect()]
    exp = pd.Series(values, dtype="float64").rolling(7, center=True).mean().tolist()
    assert len(got) == len(exp)
    for g, e in zip(got, exp):
        assert (g is None and pd.isna(e)) or abs(g - e) < 1e-9
