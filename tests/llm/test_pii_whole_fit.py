"""The trees and thresholds see every distinct labelled candidate."""

import pytest
from pyspark.sql import functions as F

from basketry.llm import pii


class Stop(Exception):
    pass


def test_every_candidate_takes_part(spark, monkeypatch):
    def stop(df, name):
        n.extend(df.groupBy("held").count().collect())
        raise Stop

    n = []
    monkeypatch.setattr(pii, "materialise", stop)
    value = F.col("id").cast("string")
    rows = spark.range(60_000).select(
        F.lit("digits").alias("gen"), F.lit("card").alias("kind"), value.alias("value"), F.lit("no ").alias("before"),
        F.lit(" x").alias("after"), value.alias("digits"), (F.col("id") % 3).alias("y"),
    )
    rows = rows.withColumn("y", F.when(F.col("y") < 2, F.col("y").cast("double")))
    with pytest.raises(Stop):
        pii.fit_trees(rows.union(rows))
    assert sum(r["count"] for r in n) == 40_000 and {r["held"] for r in n} == {True, False}
