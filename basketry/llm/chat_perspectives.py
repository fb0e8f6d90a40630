"""Chat formatting by perspective rotation: each participant of a dialogue in turn becomes the assistant.

For every participant (role) of a conversation the whole dialogue is rendered with that speaker as ``assistant`` and all
others as users named by their role; the loss mask is 1 on the speaker's own content and 0 elsewhere.  A rendering is cut
into parts of ``PART`` messages, so that no conversation, however long or crowded, is gathered in one task: its text is
that of its parts in order.  ``start`` is the part's place in the rendering, and ``mask`` holds the spans (start, end) of
the own content inside the part's text, both in code points.

Messages equal in conversation, turn, role and text are one message; without a turn or a conversation nothing says that
two rows are the same, so each stands.  Messages of one turn are ordered by role and text; null turns come last; a null
role is the participant ``unknown``; null text is empty.  Rows without conv_id form a conversation of their own.  An empty
table gives an empty result; other columns take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import materialise

PART = 64
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def header(own: Column, role: Column) -> Column:
    """What stands before a message's content."""
    return F.when(own, F.lit(f"{OPEN}assistant\n")).otherwise(F.concat(F.lit(f"{OPEN}user name="), role, F.lit("\n")))


def messages(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy): the messages; ``copy`` tells repeats apart where each of them stands."""
    rows = turns.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    once = rows.filter(known).distinct().withColumn("copy", F.lit(0).cast("long"))
    return once.unionByName(rows.filter(~known).withColumn("copy", F.monotonically_increasing_id()))


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, part, place, role, text): the messages by their place in the conversation.

    One sort by ranges of the order, so that a long conversation lies over many tasks; each range's rows are counted by
    conversation, and only those counts are summed up.
    """
    order = ["conv_id", F.col("turn").asc_nulls_last(), "role", "text", "copy"]
    ranged = messages(turns).repartitionByRange(*order).sortWithinPartitions(*order)
    said = ranged.select(
        "conv_id", "role", "text", F.monotonically_increasing_id().alias("at"), F.spark_partition_id().alias("range")
    )
    said = materialise(said, "chat_messages")
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    first = (
        said.groupBy("conv_id", "range")
        .agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
        .select(
            F.col("conv_id").alias("__conv"), F.col("range").alias("__range"),
            (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        )
    )
    return (
        said.join(first, (F.col("range") == F.col("__range")) & F.col("conv_id").eqNullSafe(F.col("__conv")))
        .withColumn("place", F.col("at") + F.col("shift"))
        .select("conv_id", F.floor(F.col("place") / PART).alias("part"), "place", "role", "text")
    )


def starts(parts: DataFrame, speakers: DataFrame) -> DataFrame:
    """(__conv, speaker, __part, start): each part's place in the renderings, from lengths alone."""
    n = lambda c: F.length(c).cast("long")
    # all lines as those of others; an own line's header is longer or shorter than that by a fixed number
    other = F.aggregate(
        "lines", F.lit(0).cast("long"), lambda acc, m: acc + n(header(F.lit(False), m["role"])) + n(m["text"]) + n(F.lit(CLOSE))
    )
    sizes = parts.select("conv_id", "part", other.alias("length"), F.transform("lines", lambda m: m["role"]).alias("roles"))
    own = F.size(F.filter("roles", lambda r: r == F.col("speaker"))).cast("long")
    gain = n(header(F.lit(True), F.col("speaker"))) - n(header(F.lit(False), F.col("speaker")))
    before = Window.partitionBy("__conv", "speaker").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return (
        sizes.join(speakers, F.col("conv_id").eqNullSafe(F.col("__conv")))
        .select("__conv", "speaker", F.col("part").alias("__part"), (F.col("length") + own * gain).alias("length"))
        .withColumn("start", F.coalesce(F.sum("length").over(before), F.lit(0).cast("long")))
        .drop("length")
    )


def rotate_perspectives(turns: DataFrame) -> DataFrame:
    """(conv_id, speaker, part, start, text, mask, n_messages, n_own): every participant's rendering, part by part."""
    line = F.struct("place", "role", "text")
    parts = numbered(turns).groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    parts = materialise(parts, "chat_parts")
    speakers = parts.select(F.col("conv_id").alias("__conv"), F.explode("lines.role").alias("speaker")).distinct()
    placed = starts(parts, speakers)
    own = lambda m: m["role"] == F.col("speaker")
    rendered = (
        parts.join(placed, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("part") == F.col("__part")))
        .withColumn("heads", F.transform("lines", lambda m: header(own(m), m["role"])))
        .withColumn("pieces", F.zip_with("heads", "lines", lambda h, m: F.concat(h, m["text"], F.lit(CLOSE))))
        .withColumn("lengths", F.transform("pieces", lambda p: F.length(p).cast("long")))
    )
    # the place of each message in the part: a running sum, then the spans of the speaker's content
    places = F.aggregate(
        "lengths",
        F.array(F.lit(0).cast("long")),
        lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)),
    )
    spans = F.transform(
        F.filter(
            F.arrays_zip(F.col("places").alias("at"), F.col("heads").alias("head"), F.col("lines").alias("line")),
            lambda z: z["line"]["role"] == F.col("speaker"),
        ),
        lambda z: F.struct(
            (z["at"] + F.length(z["head"])).alias("start"),
            (z["at"] + F.length(z["head"]) + F.length(z["line"]["text"])).alias("end"),
        ),
    )
    return (
        rendered.withColumn("places", places)
        .withColumn("mask", spans)
        .select(
            "conv_id", "speaker", "part", "start", F.array_join("pieces", "").alias("text"), "mask",
            F.size("lines").alias("n_messages"), F.size("mask").alias("n_own"),
        )
    )
