"""Sharding by a Feistel permutation over global row numbers.

Every row gets a global number; a keyed permutation of those numbers (``common.feistel``, cycle walking) gives its
position in a reproducible shuffle, and shard and slot are computed from the position alone.  Law ``rows``: the shards'
row counts differ by at most one, slots are gapless from 0.

Nulls, empty texts and repeated rows are rows like any other (rows equal in all ordering columns are interchangeable);
an empty table gives an empty result; columns besides the ones named are carried along untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import feistel, row_numbers


def shard_rows(df: DataFrame, n_shards: int, order: list[str], seed: int = 17) -> DataFrame:
    """``df`` with ``shard`` (0 .. n_shards-1) and ``slot``; columns of those names are replaced.

    ``order`` names the columns that number the rows.  The count of the rows is one number on the driver.
    """
    df = df.drop("shard", "slot")
    rows = df.count()
    return (
        feistel(row_numbers(df, order, "__row", rows), "__position", F.col("__row"), F.lit(max(rows, 1)), F.lit(seed))
        .withColumn("shard", (F.col("__position") % n_shards).cast("int"))
        .withColumn("slot", F.floor(F.col("__position") / n_shards).cast("long"))
        .drop("__row", "__position")
    )


def shard_documents(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """Digest of the sharding of ``docs``: doc_id, size (UTF-8 bytes + 1), text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
    )
    return shard_rows(sized, n_shards, ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
