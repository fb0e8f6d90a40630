"""Centred 7-row rolling mean."""

import datetime as dt

from basketry.operators.series import rolling_7d


def _daily(spark, n):
    rows = [(dt.date(2013, 1, 1) + dt.timedelta(days=2 * i), i + 1) for i in range(n)]  # gaps: row-based
    return spark.createDataFrame(rows, "fecha date, n_transacciones long")


def test_six_days_all_null(spark):
    out = rolling_7d(_daily(spark, 6)).collect()
    assert [r.rolling_7d for r in out] == [None] * 6


def test_eight_days_two_values(spark):
    out = rolling_7d(_daily(spark, 8)).collect()
    assert [r.rolling_7d for r in out] == [None, None, None, 4.0, 5.0, None, None, None]
    assert out[0].fecha == "2013-01-01"


def test_against_pandas(spark):
    import pandas as pd

    df = _daily(spark, 40)
    got = [r.rolling_7d for r in rolling_7d(df).collect()]
    exp = pd.Series(range(1, 41)).rolling(7, center=True).mean().tolist()
    assert [None if pd.isna(e) else e for e in exp] == got


def test_calendar_variant_against_pandas(spark):
    import pandas as pd

    dates = [dt.date(2013, 1, 1) + dt.timedelta(days=d) for d in [0, 1, 2, 4, 5, 9, 10, 11, 12, 13, 14, 20]]
    vals = list(range(1, len(dates) + 1))
    df = spark.createDataFrame(list(zip(dates, vals)), "fecha date, n_transacciones long")
    got = {r.fecha: r.rolling_7d for r in rolling_7d(df, calendar=True).collect()}
    full = pd.Series(vals, index=pd.to_datetime(dates)).asfreq("D", fill_value=0)
    exp = full.rolling(7, center=True).mean()
    for d in dates:
        e = exp[pd.Timestamp(d)]
        g = got[d.isoformat()]
        assert (g is None and pd.isna(e)) or abs(g - e) < 1e-9
