"""Products bought together: frequent pairs over baskets and rules with support, confidence and lift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.schemas import VISIT_KEY
from basketry.session import materialise

#: Products a row of a basket holds when its pairs are built.
BLOCK = 128


def visit_baskets(enriched: DataFrame) -> DataFrame:
    """(fecha, sucursal_id, cliente_id, productos): the distinct products of every visit."""
    return enriched.groupBy(*VISIT_KEY).agg(F.collect_set("producto_id").alias("productos"))


def product_pairs(baskets: DataFrame) -> DataFrame:
    """(producto_id, recomendado): every two different products of every basket once, the smaller first.

    Long baskets are cut to blocks of ``BLOCK`` products, of which every two meet in a row of their own, dealt to all
    tasks: no task builds a long basket's pairs alone.
    """
    spark = baskets.sparkSession
    items = baskets.select(F.array_sort(F.array_distinct(F.filter("productos", lambda p: p.isNotNull()))).alias("items"))
    items = items.filter(F.size("items") > 1)
    block = lambda i: F.slice("items", i * F.lit(BLOCK) + 1, F.lit(BLOCK))
    last = F.floor((F.size("items") - 1) / F.lit(BLOCK)).cast("int")
    short = items.filter(F.size("items") <= BLOCK).select(F.col("items").alias("mine"), F.col("items").alias("others"), F.lit(True).alias("same"))
    long = items.filter(F.size("items") > BLOCK).select("items", F.explode(F.sequence(F.lit(0), last)).alias("i"), last.alias("last"))
    long = long.select("items", "i", F.explode(F.sequence(F.col("i"), F.col("last"))).alias("j"))
    long = long.select(block(F.col("i")).alias("mine"), block(F.col("j")).alias("others"), (F.col("i") == F.col("j")).alias("same"))
    long = long.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "mine", "others")
    # sorted, so the pairs of a block with itself are those of each product with the later ones
    first = short.unionByName(long).select(F.posexplode("mine").alias("at", "producto_id"), "others", "same")
    later = F.when(F.col("same"), F.slice("others", F.col("at") + 2, F.lit(BLOCK))).otherwise(F.col("others"))
    return first.select("producto_id", F.explode(later).alias("recomendado"))


def product_rules(baskets: DataFrame, min_count: int = 2, min_confidence: float = 0.0) -> DataFrame:
    """producto_id, recomendado, n_visitas, soporte, confianza, lift: for each product what is bought in the same visits.

    ``min_count``: visits that a pair needs.  Pairs are built from the baskets and counted with map-side reduction; longer
    itemsets, of which no rule has any, are not.  A rule's confidence is the share of the product's visits that hold the
    other.  Baskets of one product only count as visits.  An empty table gives no rule.
    """
    # read twice, for products and for pairs
    baskets = materialise(baskets.select("productos"), "baskets")
    total = baskets.count()
    bought = baskets.select(F.explode(F.array_distinct("productos")).alias("producto_id"))
    single = bought.groupBy("producto_id").agg(F.count(F.lit(1)).alias("n")).filter("producto_id is not null")
    both = product_pairs(baskets).groupBy("producto_id", "recomendado").agg(F.count(F.lit(1)).alias("freq"))
    ends = F.array(F.struct("producto_id", "recomendado"), F.struct(F.col("recomendado").alias("producto_id"), F.col("producto_id").alias("recomendado")))
    pairs = both.filter(F.col("freq") >= min_count).select("freq", F.inline(ends))
    other = single.select(F.col("producto_id").alias("recomendado"), F.col("n").alias("n_other"))
    confidence = F.col("freq") / F.col("n")
    return (
        pairs.join(single, "producto_id")
        .join(other, "recomendado")
        .filter(confidence >= min_confidence)
        .select(
            "producto_id",
            "recomendado",
            F.col("freq").alias("n_visitas"),
            (F.col("freq") / F.lit(total)).alias("soporte"),
            confidence.alias("confianza"),
            (confidence / (F.col("n_other") / F.lit(total))).alias("lift"),
        )
    )


def recommend(rules: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` best recommendations of every product: by confidence, then lift, then the smaller product."""
    best = F.array_sort(F.collect_list(F.struct((-F.col("confianza")).alias("c"), (-F.col("lift")).alias("l"), F.col("recomendado"))))
    top = rules.groupBy("producto_id").agg(F.slice(best, 1, k).alias("best"))
    return top.select("producto_id", F.posexplode("best").alias("pos", "b")).select(
        "producto_id",
        (F.col("pos") + 1).alias("puesto"),
        F.col("b.recomendado").alias("recomendado"),
        (-F.col("b.c")).alias("confianza"),
        (-F.col("b.l")).alias("lift"),
    )
