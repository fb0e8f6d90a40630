"""Mixing sources to target weights: token blocks, slots of output shards, per-source index permutations, block join.

1. Sizes (words) are counted once; sources by code point (null last) get weights 1, 2, 3 repeating and share all words;
   a target stops at ``max_epochs`` times its source's size and the excess is reshared by weight (water filling).
2. Each source's documents are packed end to end, in a hash order, into blocks of ``block_words`` words.
3. The output has as many slots as the targets ask for.  A keyed permutation of all slots deals the sources over the
   output shards: a shard's source counts are a multinomial draw conditioned on the totals (drawn without replacement),
   because free draws miss the targets of small sources and would break the limit of ``max_epochs``.
4. The k-th slot of a source is block ``perm(k mod n_blocks)`` of epoch ``k div n_blocks``, with one permutation for each
   source and epoch; slots meet blocks in an equi-join on (source, block).  The last slot of a source may be a partial one.

Null or empty texts have size 0 and are never taken; a null source is a source of its own; an empty table gives an empty
result; rows with a null doc_id are documents like others, told apart by source and text; rows repeated with equal doc_id, source and text are packed one by one in ``taken_words`` and are one document in
``mixed_documents``.  Other columns, whatever their names, take no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import feistel, materialise, word_count, words

BLOCK_WORDS = 128
SLOTS_PER_SHARD = 4096
#: Hash buckets of a source's documents, and cells of the slot range: rows of small driver-free tables.
BUCKETS = 2048


def source_targets(sizes: DataFrame, max_epochs: int = 3) -> DataFrame:
    """(source, source_id, source_size, weight, target): one row a source; its windows run over sources, not documents."""
    total = Window.partitionBy(F.lit(0))
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    fill = Window.partitionBy(F.lit(0)).orderBy("ratio", "source_id")
    stats = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("source_id", F.row_number().over(by_name) - 1)
        .withColumn("weight", (F.col("source_id") % 3 + 1).cast("double"))
        .withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("all_words", F.sum("source_size").over(total).cast("double"))
    )
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("all_words") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(
        fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    )
    fits = F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source_id", "level"))
    return (
        stats.withColumn("level", level)
        .withColumn("level", F.min(fits).over(total)["level"])
        .select(
            "source", "source_id", "source_size", "weight", F.least("cap", F.col("level") * F.col("weight")).alias("target")
        )
    )


def pack(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """``sizes`` with its source's columns and ``start``, its first word's place in the source's stream.

    Two levels of running sums, so that a source with most of the rows is no single task's work.
    """
    keyed = sizes.join(F.broadcast(targets), sizes["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    keyed = materialise(
        keyed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(BUCKETS)).cast("int")), "mix_sizes"
    )
    within = Window.partitionBy("source_id", "bucket").orderBy("doc_id", "text_hash", "size")
    before = Window.partitionBy("source_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy("source_id", "bucket")
        .agg(F.sum("size").alias("words"))
        .select("source_id", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    )
    start = F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    return (
        keyed.withColumn("start", start)
        .join(offsets, ["source_id", "bucket"])
        .withColumn("start", F.col("start") + F.col("offset"))
        .drop("offset", "bucket")
    )


def slots(targets: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 6) -> DataFrame:
    """(shard, slot, source_id, epoch, block, words): which block every output slot holds, and how many words of it."""
    spark = targets.sparkSession
    upto = Window.partitionBy(F.lit(0)).orderBy("source_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = F.ceil(F.col("source_size") / F.lit(block_words))
    plan = (
        targets.filter("source_size > 0")
        .withColumn("n_blocks", blocks.cast("long"))
        .withColumn("asked", F.col("target") * F.col("n_blocks") / F.col("source_size"))
        .withColumn("quota", F.ceil(F.col("asked") - 1e-9).cast("long"))
        .withColumn("stop", F.sum("quota").over(upto))
        .withColumn("first", F.col("stop") - F.col("quota"))
        .select("source_id", "source_size", "n_blocks", "asked", "quota", "first", "stop")
    )
    plan = materialise(plan, "mix_plan")
    n = plan.agg(F.max("stop")).first()[0] or 0
    cell = max(1, -(-n // BUCKETS))
    spans = plan.filter("quota > 0").withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("first") / cell), F.floor((F.col("stop") - 1) / cell)))
    )
    dealt = (
        feistel(spark.range(n), "g", F.col("id"), F.lit(max(n, 1)), F.lit(seed))
        .withColumn("cell", F.floor(F.col("g") / cell))
        .join(F.broadcast(spans), "cell")  # at most BUCKETS rows and one more a source
        .filter("g >= first and g < stop")
        .withColumn("k", F.col("g") - F.col("first"))
        .withColumn("epoch", F.floor(F.col("k") / F.col("n_blocks")).cast("int"))
    )
    key = F.xxhash64("source_id", "epoch", F.lit(seed))
    return (
        feistel(dealt, "block", F.col("k") % F.col("n_blocks"), F.col("n_blocks"), key)
        .withColumn("held", F.least(F.lit(block_words), F.col("source_size") - F.col("block") * block_words))
        .withColumn("part", F.least(F.lit(1.0), F.col("asked") - F.col("k")))
        .select(
            F.floor(F.col("id") / SLOTS_PER_SHARD).alias("shard"),
            (F.col("id") % SLOTS_PER_SHARD).alias("slot"),
            "source_id",
            "epoch",
            "block",
            F.round(F.col("held") * F.col("part")).cast("long").alias("words"),
        )
    )


def sized(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"),
        F.xxhash64("text").alias("text_hash"),
    )


def pieces(docs: DataFrame, block_words: int = BLOCK_WORDS, max_epochs: int = 3) -> tuple[DataFrame, DataFrame]:
    """The packed documents, and the parts of them that the output slots hold: (shard, slot, epoch, offset, words, ...)."""
    sizes = materialise(sized(docs), "mix_counts")
    targets = materialise(source_targets(sizes, max_epochs), "mix_targets")
    packed = materialise(pack(sizes, targets), "mix_packed")
    first, last = F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)
    cut = (
        packed.filter("size > 0")
        .withColumn("source_hash", F.xxhash64("source"))
        .select("source_id", "source_hash", "doc_id", "text_hash", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
        .withColumn("from", F.greatest(F.col("start"), F.col("block") * block_words))
        .withColumn("to", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words))
    )
    held = slots(targets, block_words).withColumnRenamed("words", "slot_words")
    taken = F.least(F.col("to"), F.col("block") * block_words + F.col("slot_words")) - F.col("from")
    used = (
        cut.join(held, ["source_id", "block"])
        .withColumn("words", taken)
        .filter("words > 0")
        .withColumn("offset", F.col("from") - F.col("start"))
    )
    return packed, used


def taken_words(docs: DataFrame, block_words: int = BLOCK_WORDS, max_epochs: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, taken: how many words of each document the mix takes, repeats counted."""
    packed, used = pieces(docs, block_words, max_epochs)
    taken = used.groupBy("source_id", "start").agg(F.sum("words").alias("taken"))
    zero = F.lit(0).cast("long")
    # a document of size 0 shares its start with the next one, but nothing of it is taken
    return packed.join(taken, ["source_id", "start"], "left").select(
        "doc_id",
        "size",
        "source_size",
        "target",
        F.when(F.col("size") > 0, F.coalesce("taken", zero)).otherwise(zero).alias("taken"),
    )


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, max_epochs: int = 3) -> DataFrame:
    """The mix as documents: one row per document and epoch, its text the words taken (the whole text, if all are)."""
    _, used = pieces(docs, block_words, max_epochs)
    plan = (
        used.groupBy("doc_id", "source_hash", "text_hash", "epoch", "size")
        .agg(F.sum("words").alias("n"), F.array_sort(F.collect_list(F.struct("offset", "words"))).alias("parts"))
        .select(
            F.col("doc_id").alias("__id"),
            F.col("source_hash").alias("__source"),
            F.col("text_hash").alias("__hash"),
            (F.col("n") >= F.col("size")).alias("__whole"),
            "parts",
        )
    )
    tokens = F.when(~F.col("__whole"), words(F.col("text")))
    # two uses of __words: Spark would put its only one into the lambda and split the text for every part
    cut = F.transform("parts", lambda p: F.slice("__words", (p["offset"] + 1).cast("int"), p["words"].cast("int")))
    chosen = F.when(F.size("__words") > 0, F.array_join(F.flatten(cut), " "))
    text = F.when(F.col("__whole"), F.col("text")).otherwise(chosen)
    names = docs.columns
    once = docs.withColumns({"__hash": F.xxhash64("text"), "__source": F.xxhash64(F.col("source").cast("string"))})
    same = (once["__hash"] == plan["__hash"]) & (once["__source"] == plan["__source"])
    return (
        once.join(plan, F.col("doc_id").eqNullSafe(F.col("__id")) & same)
        .withColumn("__words", tokens)
        .withColumn("text", text)
        .withColumn("n_chars", F.length("text").cast("long"))
        .select(*names)
    )
