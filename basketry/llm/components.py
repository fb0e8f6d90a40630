"""Connected components of a link table, by alternating large-star and small-star steps over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import materialise


def _stars(links: DataFrame) -> bool:
    """Whether every ``hi`` has one ``lo`` and no ``lo`` is a ``hi``: then each ``lo`` is the least id of its component."""
    ends = F.array(
        F.struct(F.col("hi").alias("id"), F.lit(1).alias("up")), F.struct(F.col("lo").alias("id"), F.lit(0).alias("up"))
    )
    roles = links.select(F.inline(ends)).groupBy("id").agg(F.sum("up").alias("ups"), F.min("up").alias("low"))
    return roles.filter("ups > 1 or (ups > 0 and low = 0)").agg(F.count(F.lit(1))).first()[0] == 0


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id with a link to another one; component is the smallest id reachable.

    Every step is a grouping and an equi-join; the tables are written in between, and only one number reaches the driver.
    Links that form stars already are answered without a step.
    """
    links = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
    links = materialise(links.distinct(), "cc_links")
    while not _stars(links):
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(links.select("lo", "hi"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = materialise(large.distinct(), "cc_large")
        root = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(root, "hi").filter("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        links = materialise(moved.union(root.select("hi", "m")).distinct(), "cc_small")
    roots = links.select("lo").distinct()
    return links.select(F.col("hi").alias("id"), F.col("lo").alias("component")).union(roots.select("lo", "lo"))
