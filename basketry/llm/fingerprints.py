"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the sorted array of the ``K`` least 64-bit hashes of a text's distinct word shingles (five words; a shorter
text is one shingle).  Sketches of parts merge into the sketch of the whole.  Of two sketches, the bottom k of their union
estimate resemblance and containment, and the k-th value estimates the number of distinct shingles; a sketch of fewer
than ``K`` values is the whole set, and its figures are exact.  As text, a sketch is its values in hexadecimal.

Null or empty text and text without words have the empty sketch: it resembles another empty one by 1 and any other by 0.
The next document of the last (least) doc_id is the first; a table of one document is its own next.  Rows with the same
doc_id, and rows without one, are ordered by their text; an empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import words
from basketry.llm.near_dedup import shingle_hashes

K, SHINGLE = 64, 5
#: Ranges of doc_id that are worked on apart; as many documents at most are handed on to the next range.
RANGES = 256


def sketch_of_tokens(tokens: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(tokens, SHINGLE))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of the two sketched sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_rows(df: DataFrame, keys: list[str], sketch: str, k: int = K) -> DataFrame:
    """(keys, sketch): one merged sketch per key, from rows that hold sketches of parts.

    Values are made distinct and ranked per key; a rank filter keeps k rows a key in each task before the shuffle.
    """
    values = df.select(*keys, F.explode_outer(sketch).alias("v")).distinct()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("v").asc_nulls_last()))
    least = values.withColumn("r", rank).filter(F.col("r") <= k)
    return least.groupBy(*keys).agg(F.sort_array(F.collect_list("v")).alias(sketch))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of the sketched sets."""
    union = merge(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles."""
    place = (F.get(a, F.lit(k - 1)).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / place)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the first set's shingles that the second one holds."""
    whole = distinct_shingles(merge(a, b, k), k)
    share = resemblance(a, b, k) * whole / distinct_shingles(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), share))


def as_text(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda v: F.lpad(F.lower(F.hex(v)), 16, "0")), "")


def _ranged(df: DataFrame, bounds: list[int]) -> DataFrame:
    """``df`` with ``range``: the number of bounds less than its doc_id (null ids: before all)."""
    below = F.aggregate(
        F.lit(bounds).cast("array<bigint>"), F.lit(0), lambda n, b: n + (F.col("doc_id") > b).cast("int")
    )
    return df.withColumn("range", F.coalesce(below, F.lit(-1)))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, range, last, next_text) in descending doc_id order; the text is never null.

    Documents are dealt to ranges of doc_id between approximate quantiles, and each range gets a copy of the first
    document of the range below it, so that one shuffle by range is all that moves texts.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = [i / RANGES for i in range(1, RANGES)]
    bounds = sorted(set(ids.agg(F.percentile_approx("doc_id", cuts, 20_000)).first()[0] or []))
    tops = (
        _ranged(ids.select("doc_id"), bounds).groupBy("range").agg(F.max("doc_id").alias("top"))
    )  # at most RANGES + 1 rows
    upper = Window.partitionBy(F.lit(0)).orderBy("range")
    tops = (
        tops.withColumn("to", F.lead("range").over(upper))
        .withColumn("to", F.coalesce("to", F.min("range").over(Window.partitionBy(F.lit(0)))))
        .select("top", "to")
    )
    texts = _ranged(ids, bounds)
    first = F.max(F.struct(F.xxhash64("text").alias("h"), "text"))["text"]
    handed = (
        ids.join(F.broadcast(tops), F.col("doc_id").eqNullSafe(F.col("top")))
        .groupBy("doc_id", "to")
        .agg(first.alias("text"))
        .select("doc_id", "text", F.col("to").alias("range"), F.lit(True).alias("last"))
    )
    order = ["last", F.col("doc_id").desc_nulls_last(), F.desc("hash")]
    everything = texts.withColumn("last", F.lit(False)).unionByName(handed).withColumn("hash", F.xxhash64("text"))
    return everything.withColumn("next_text", F.lead("text").over(Window.partitionBy("range").orderBy(*order)))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_shingles, edited_contains.

    The edited text has its last half replaced by the beginning of the next document in descending doc_id.
    """
    text = F.col("text")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    kept = F.substring(text, F.lit(1), F.col("n_chars").cast("int") - half)
    order = ["last", F.col("doc_id").desc_nulls_last(), F.desc("hash")]
    by_range = Window.partitionBy("range").orderBy(*order)
    sketched = (
        with_next(docs)
        .withColumn("n_chars", F.length(text).cast("long"))
        .withColumn("edited", F.concat(kept, F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half)))
        .select(
            "doc_id", "range", "last", "hash", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
            words(text).alias("own_words"), words(F.col("edited")).alias("edited_words"),
        )
        .select(
            "doc_id", "range", "last", "hash", "n_chars", "edited_sha256",
            sketch_of_tokens(F.col("own_words")).alias("own"),
            sketch_of_tokens(F.col("edited_words")).alias("edited"),
        )
        .withColumn("next", F.lead("own").over(by_range))
        .filter(~F.col("last"))
    )
    return sketched.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("edited")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("edited")).alias("near_edited"),
        resemblance(F.col("own"), F.col("next")).alias("near_next"),
        distinct_shingles(F.col("own")).alias("n_shingles"),
        containment(F.col("own"), F.col("edited")).alias("edited_contains"),
    )
