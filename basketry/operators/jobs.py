"""Job-log style reports: newest record per key and the last N records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the highest ``order`` value per ``key``.

    A hash aggregate finds the highest value per key with partial (map-side)
    merging of two narrow columns; an equi-join on (key, value) then fetches
    the row, so no partition is sorted by a key with few values.  Both are
    compared null-safe: a null key is a key, and a key whose ``order`` values
    are all null gives its rows.  Rows that tie for the highest value are all
    returned.
    """
    top = df.groupBy(key).agg(F.max(order).alias("__order")).withColumnRenamed(key, "__key")
    same = df[key].eqNullSafe(top["__key"]) & df[order].eqNullSafe(top["__order"])
    return df.join(top, same, "left_semi").select(key, *[c for c in df.columns if c != key])


def recent_n(df: DataFrame, order: str, n: int = 20) -> DataFrame:
    """Last ``n`` records by ``order`` (a top-k: per-partition then a k-row merge)."""
    return df.orderBy(F.desc(order)).limit(n)
