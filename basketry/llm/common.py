"""Helpers shared by the operators of this subpackage: text, scratch tables, row numbers, permutations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketry.session import materialise  # noqa: F401

#: Separators of words in every contract: space and the controls 9 to 13.
WHITESPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Maximal runs of non-separators; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITESPACE), "")


def word_count(text: Column) -> Column:
    """Number of ``words``, counted on strings: no array of a long text's words is built."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.length(F.translate(marks, " \t\n\x0b\f\r", "")).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all other characters as they are."""
    return F.translate(text, UPPER, LOWER)


#: Rows of at most 64 bytes each that a broadcast may hold: 32 MB.
BROADCAST_ROWS = 500_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark fixed-width ``df`` for broadcast if an exact count proves it small; else Spark shuffles it."""
    return F.broadcast(df) if df.count() <= rows else df


#: Rows a hash bucket of ``row_numbers`` holds on average, and the least number of buckets.
BUCKET_ROWS, LEAST_BUCKETS = 100_000, 4096


def row_numbers(df: DataFrame, order: Sequence[str], name: str, rows: int) -> DataFrame:
    """``df`` of ``rows`` rows with ``name``, the gapless number from 0 of each in the order (bucket of ``order``'s hash, ``order``).

    Two-level: rows are numbered inside hash buckets in parallel, and the buckets' sizes, a row for each ``BUCKET_ROWS``
    rows, are summed up in one small window.  Rows equal in all of ``order`` are interchangeable.
    """
    buckets = max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS))
    bucket = f"{name}_bucket"
    with_bucket = df.withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        with_bucket.groupBy(bucket)
        .agg(F.count(F.lit(1)).alias(f"{name}_n"))
        .select(bucket, F.coalesce(F.sum(f"{name}_n").over(before), F.lit(0)).alias(f"{name}_offset"))
    )
    within = F.row_number().over(Window.partitionBy(bucket).orderBy(*order)) - 1
    few = buckets <= BROADCAST_ROWS
    return (
        with_bucket.withColumn(name, within)
        .join(F.broadcast(offsets) if few else offsets, bucket)
        .withColumn(name, F.col(name) + F.col(f"{name}_offset"))
        .drop(bucket, f"{name}_offset")
    )


def feistel(df: DataFrame, name: str, x: Column, n: Column, key: Column, rounds: int = 4) -> DataFrame:
    """``df`` with ``name``: a pseudorandom permutation of 0 .. n-1 keyed by ``key``, applied to ``x``.

    A Feistel network over Z_a x Z_b with cycle walking.  ``a * b`` is the least such rectangle with ``a`` near the square
    root of ``n``, so that fewer than ``a`` points lie outside the range; a walk can pass each of those at most once,
    which bounds it exactly.
    """
    at = {c: f"__{name}_{c}" for c in ("x", "n", "a", "b", "key", "y")}
    x_, n_, a, b, key_, y = (F.col(at[c]) for c in ("x", "n", "a", "b", "key", "y"))

    def step(v: Column) -> Column:
        def one(acc: Column, i: Column) -> Column:
            left, right = acc["l"], acc["r"]
            return F.when(
                i % 2 == 0,
                F.struct(F.pmod(left + F.pmod(F.xxhash64(right, key_, i), a), a).alias("l"), right.alias("r")),
            ).otherwise(F.struct(left.alias("l"), F.pmod(right + F.pmod(F.xxhash64(left, key_, i), b), b).alias("r")))

        start = F.struct((v % a).alias("l"), F.floor(v / a).cast("long").alias("r"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, one, lambda acc: acc["l"] + a * acc["r"])

    walk = F.aggregate(
        F.sequence(F.lit(1).cast("long"), F.greatest(a * b - n_, F.lit(1))),
        y,
        lambda acc, _: F.when(acc < n_, acc).otherwise(step(acc)),
    )
    return (
        df.withColumns({at["x"]: x.cast("long"), at["n"]: n.cast("long"), at["key"]: key})
        .withColumn(at["a"], F.greatest(F.ceil(F.sqrt(n_.cast("double"))), F.lit(1)).cast("long"))
        .withColumn(at["b"], F.floor((n_ + a - 1) / a).cast("long"))
        .withColumn(at["y"], step(x_))
        .withColumn(name, F.when(y < n_, y).otherwise(walk))
        .drop(*at.values())
    )
