"""Customer segments: k-means over scaled customer features, with the number of segments chosen by silhouette."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.operators.customers import FEATURES

#: Numbers of segments that are tried.
CHOICES = (2, 3, 4, 5, 6)


@dataclass(frozen=True)
class Segments:
    """Assignment (key, features, scaled features, segment from 1) and segments (segment, customers, centre, means)."""

    assigned: DataFrame
    segments: DataFrame
    silhouettes: dict[int, float]


def segment_customers(
    features: DataFrame, columns: Sequence[str] = FEATURES, key: str = "cliente_id", choices: Sequence[int] = CHOICES, seed: int = 17
) -> Segments:
    """Segments of customers whose features are alike, the largest first.

    Features are scaled to mean 0 and deviation 1 (a constant one to 0).  Each number of segments is fitted from a seeded
    start; the one with the best silhouette is taken, the smaller of equal ones.  Rows with a null feature take no part.
    Fewer than three different customers, or an empty table, are one segment.
    """
    columns = list(columns)
    rows = features.select(key, *columns).na.drop(subset=columns)
    assembled = VectorAssembler(inputCols=columns, outputCol="raw").transform(rows)
    different = rows.select(*columns).distinct().limit(max(choices) + 1).count()
    if different < 3:
        none = F.array().cast("array<double>")
        assigned = rows.withColumns({"scaled": none, "segment": F.lit(1)})
        return Segments(assigned, _summary(assigned, columns).withColumn("centre", none), {})
    scaler = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True).fit(assembled)
    scaled = scaler.transform(assembled).drop("raw").persist()
    try:
        fitted, silhouettes = {}, {}
        for k in [k for k in choices if k < different]:
            fitted[k] = KMeans(featuresCol="scaled", predictionCol="cluster", k=k, seed=seed, maxIter=30).fit(scaled)
            silhouettes[k] = ClusteringEvaluator(featuresCol="scaled", predictionCol="cluster").evaluate(fitted[k].transform(scaled))
        best = fitted[max(silhouettes, key=lambda k: (silhouettes[k], -k))]
        sizes = best.summary.clusterSizes
    finally:
        scaled.unpersist()
    order = sorted(range(len(sizes)), key=lambda c: (-sizes[c], list(best.clusterCenters()[c])))
    number = F.element_at(F.array(*[F.lit(order.index(c) + 1) for c in range(len(sizes))]), F.col("cluster") + 1)
    assigned = best.transform(scaled).withColumn("segment", number).withColumn("scaled", vector_to_array("scaled")).drop("cluster")
    centres = features.sparkSession.createDataFrame(
        [(i + 1, [float(x) for x in best.clusterCenters()[c]]) for i, c in enumerate(order)], "segment int, centre array<double>"
    )
    return Segments(assigned, _summary(assigned, columns).join(centres, "segment"), silhouettes)


def _summary(assigned: DataFrame, columns: list[str]) -> DataFrame:
    means = [F.avg(c).alias(f"media_{c}") for c in columns]
    return assigned.groupBy("segment").agg(F.count(F.lit(1)).alias("clientes"), *means)
