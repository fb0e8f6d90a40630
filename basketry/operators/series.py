"""Rolling statistics over a daily series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.dates import iso_date


def centred_rolling_mean(series: DataFrame, value: str, order: str, width: int = 7, name: str = "rolling") -> DataFrame:
    """Centred row-based mean over ``width`` rows (odd); null unless the frame is full.

    Row-based like the source: missing dates are not filled.  The window has no
    partition key, so it runs in one task -- its input must be the aggregated
    series (one row per date, bounded by the calendar span), never raw rows.
    """
    half = width // 2
    w = Window.orderBy(order).rowsBetween(-half, half)
    full = F.count(F.lit(1)).over(w) == F.lit(width)
    return series.withColumn(name, F.when(full, F.avg(value).over(w)))


def centred_calendar_mean(series: DataFrame, value: str, date: str, days: int = 7, name: str = "rolling") -> DataFrame:
    """Centred mean over ``days`` calendar days (odd); dates absent from the
    series count as 0.  Null where the window reaches outside the series'
    first..last date.  Same bound as the row variant: one row per date."""
    half = days // 2
    day = F.unix_date(F.col(date))
    w = Window.orderBy(day).rangeBetween(-half, half)
    whole = Window.partitionBy()
    inside = (day - half >= F.min(day).over(whole)) & (day + half <= F.max(day).over(whole))
    return series.withColumn(name, F.when(inside, F.sum(value).over(w) / F.lit(float(days))))


def rolling_7d(daily: DataFrame, calendar: bool = False) -> DataFrame:
    """Daily visits with a centred 7-row mean (or 7-calendar-day mean); ``fecha`` as ISO text."""
    if calendar:
        rolled = centred_calendar_mean(daily, "n_transacciones", "fecha", 7, "rolling_7d")
    else:
        rolled = centred_rolling_mean(daily, "n_transacciones", "fecha", 7, "rolling_7d")
    return rolled.select(iso_date("fecha").alias("fecha"), "n_transacciones", "rolling_7d").orderBy("fecha")
