"""Benchmark decontamination by template canonicalisation.

Texts become templates: numbers, units after a number, and names (capitalised words inside a sentence) turn into typed
placeholders; other words lose case and punctuation.  Hashes of all windows of ``WINDOW`` tokens of every whole
document meet those of the benchmark in an equi-join.  Windows on one diagonal (same document, item and distance) form a
passage.  Its slots are compared: each value of the item must stand for one value of the document (two of the item's may
come to the same), for the share ``CONSISTENT`` of the item's values at least; or more than the share ``VERBATIM`` of
the item's windows stand there word for word.  So verbatim and re-parameterised copies are caught, also with a changed value among many, and
texts that only share a shape are not.

A passage counts if it has ``RUN`` windows, or all the item's if those are fewer.  Windows with fewer than ``LITERALS``
plain words say too little and are not indexed.  An item's first word is indexed both as a name and as a plain word, as
either can come out behind other text.  Items without any indexed window (dense in numbers or names, or shorter than a
window) are matched word for word: their untemplated windows, or the whole item if that is shorter, meet those of the
documents.  Items of fewer than ``LITERALS`` tokens cannot be told from chance and match nothing.

Null or empty texts match nothing; rows with the same doc_id are one document; rows without doc_id are one document for
each text, found and dropped like others, and reported with a null doc_id; repeated items are each reported; an empty
table on either side gives an empty result; other columns are carried along untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import broadcast_if_small, materialise

WINDOW, RUN, LITERALS = 8, 6, 4
CONSISTENT, VERBATIM = 0.8, 2 / 3

#: Units of measure, money and time that may follow a number.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg t lb lbs oz ton tons ml l liter liters litre "
    "litres gallon gallons second seconds sec minute minutes min hour hours h day days week weeks month months year years "
    "percent % dollar dollars usd eur euro euros pound pounds gbp cent cents degree degrees c f k w kw kwh v mph kmh hz khz "
    "mhz ghz kb mb gb tb"
).split()
#: Private characters that stand for a number, a unit and a name.
NUM, UNIT, NAME = "\ue000", "\ue001", "\ue002"
BLANK = r"[\x20\x09-\x0D]"
#: Everything between tokens: blanks, ASCII and Latin-1 symbols, general punctuation.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\xBF\u2000-\u206F]+"


def template(text: Column, keep: bool = False) -> Column:
    """The text with placeholders for its numbers, units and names; ``keep`` leaves each value behind its placeholder."""
    value = lambda mark, group: mark + f"${group}" * keep
    out = F.coalesce(text, F.lit(""))
    out = F.regexp_replace(out, r"[.,:](?<=[0-9][.,:])(?=[0-9])", "")
    # a capitalised word after a blank, with no end of a sentence before that
    name = rf"(\p{{Lu}}(?<=[^.!?:\x20\x09-\x0D]{BLANK}\p{{Lu}})\p{{Ll}}[\p{{L}}\p{{M}}]*+)"
    out = F.regexp_replace(out, name, value(NAME, 1))
    out = F.regexp_replace(out, "([0-9]++)", value(NUM, 1))
    units = "|".join(u for u in UNITS if u.isalpha())
    out = F.regexp_replace(
        out, rf"(?i){NUM}([0-9]*+)({BLANK}*+)({units})(?![\p{{L}}\p{{M}}])", value(NUM, 1) + " " + value(UNIT, 3)
    )
    return F.lower(out)


def tokens(templated: Column) -> Column:
    return F.array_remove(F.split(templated, SEPARATORS), "")


def windows(df: DataFrame, *keys: str, width: int = WINDOW) -> DataFrame:
    """(keys, pos, hash): every window of ``width`` tokens (column ``__tokens``)."""
    hashes = df.select(*keys, F.transform("__tokens", lambda t: F.xxhash64(t)).alias("__h"))
    window = F.transform(
        F.sequence(F.lit(0), F.size("__h") - width), lambda i: F.xxhash64(*(F.get("__h", i + j) for j in range(width)))
    )
    every = hashes.select(*keys, F.when(F.size("__h") >= width, window).alias("__w"))
    # the outer form: for the plain one Spark infers a filter and pushes it down, which would build all hashes again
    return every.select(*keys, F.posexplode_outer("__w").alias("pos", "hash")).filter("pos is not null")


def document_key() -> Column:
    """What tells documents apart: the doc_id, or a digest of the text where that is null."""
    text = F.coalesce("text", F.lit(""))
    digest = F.concat(F.lit("t"), F.hex(F.xxhash64(text)), F.hex(F.xxhash64(F.lit(5), text)))
    return F.coalesce(F.concat(F.lit("d"), F.col("doc_id").cast("string")), digest)


def find_passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, windows, item_windows, slots, reparameterised): the consistent passages, one row each.

    ``doc_id`` may be of any type and is never null here, see :func:`document_key`.
    """
    items = benchmark.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text").distinct()
    # the item's first word may be taken for a name or not, as the words before it in a document have it
    starts = items.withColumn("__start", F.explode(F.array(F.lit(""), F.lit("x "))))
    started = F.concat("__start", "text")
    after = lambda array: F.when(F.col("__start") == "", array).otherwise(F.slice(array, 2, 1 << 30))
    canonical = starts.withColumn("__tokens", after(tokens(template(started)))).select("item", "__tokens")
    plain = F.filter(F.slice("__tokens", F.col("ipos") + 1, WINDOW), lambda t: ~t.rlike(f"[{NUM}{UNIT}{NAME}]"))
    canonical = materialise(canonical, "bench_tokens")
    indexed = (
        windows(canonical.withColumn("__id", F.monotonically_increasing_id()), "item", "__id")
        .groupBy("item", "hash")
        .agg(F.min("pos").alias("ipos"))
        .join(canonical.groupBy("item").agg(F.first("__tokens").alias("__tokens")), "item")
        .filter(F.size(plain) >= LITERALS)
        .select("item", "hash", "ipos")
    )
    indexed = materialise(indexed, "bench_windows")
    counts = indexed.groupBy("item").agg(F.countDistinct("ipos").alias("item_windows"))
    texts = docs.select("doc_id", "text")
    hits = (
        windows(texts.select("doc_id", tokens(template(F.col("text"))).alias("__tokens")), "doc_id")
        .join(broadcast_if_small(indexed), "hash")
        .groupBy("doc_id", "item", (F.col("pos") - F.col("ipos")).alias("shift"))
        .agg(
            F.countDistinct("ipos").alias("windows"),
            F.min("pos").alias("from"),
            (F.max("pos") + WINDOW - F.min("pos")).alias("length"),
        )
        .join(counts, "item")
        .filter(F.col("windows") >= F.least(F.lit(RUN), F.col("item_windows")))
    )
    hits = materialise(hits, "bench_hits")
    wanted = broadcast_if_small(hits.select("doc_id").distinct())
    valued = lambda text: tokens(template(text, keep=True))
    found = texts.join(wanted, "doc_id", "left_semi").select("doc_id", valued(F.col("text")).alias("there"))
    own = starts.filter("__start = 'x '").select("item", "item_id", after(valued(started)).alias("__tokens"))
    here = F.slice(F.col("__tokens"), F.col("from") - F.col("shift") + 1, F.col("length"))
    pairs = F.arrays_zip(here.alias("i"), F.slice("there", F.col("from") + 1, F.col("length")).alias("d"))
    mark = lambda t: F.regexp_extract(t, f"[{NUM}{UNIT}{NAME}]", 0)
    bare = lambda t: F.translate(t, NUM + UNIT + NAME, "")
    slots = F.array_distinct(
        F.transform(
            F.filter(pairs, lambda p: (mark(p["i"]) != "") & (mark(p["i"]) == mark(p["d"]))),
            lambda p: F.struct(p["i"].alias("i"), p["d"].alias("d")),
        )
    )
    # a 1 for each token that is the same on both sides: a run of n of them holds n - WINDOW + 1 windows
    same = F.array_join(F.transform(pairs, lambda p: F.when(bare(p["i"]) == bare(p["d"]), "1").otherwise("0")), "")
    runs = F.regexp_extract_all(same, F.lit(f"(1{{{WINDOW},}})"), F.lit(1))
    verbatim = F.aggregate(runs, F.lit(0), lambda acc, r: acc + F.length(r) - (WINDOW - 1))
    values = F.array_distinct(F.transform("__slots", lambda s: s["i"]))
    steady = F.filter(values, lambda v: F.size(F.filter("__slots", lambda s: s["i"] == v)) == 1)
    passages = (
        hits.join(found, "doc_id")
        .join(own, "item")
        .withColumn("__slots", slots)
        .filter(
            (F.size(steady) >= F.lit(CONSISTENT) * F.size(values)) | (verbatim > F.lit(VERBATIM) * (F.size("__tokens") - (WINDOW - 1)))
        )
        .select(
            "doc_id",
            "item_id",
            "windows",
            "item_windows",
            F.size("__slots").alias("slots"),
            F.exists("__slots", lambda s: s["i"] != s["d"]).alias("reparameterised"),
        )
    )
    exact = find_verbatim(texts, items.join(counts, "item", "left_anti"))
    return passages if exact is None else passages.unionByName(exact)


def find_verbatim(texts: DataFrame, items: DataFrame) -> DataFrame | None:
    """The passages of ``items`` that stand in ``texts`` word for word, as rows of ``find_passages``; None without items."""
    plain = items.select("item", "item_id", tokens(F.lower(F.coalesce("text", F.lit("")))).alias("__tokens"))
    plain = plain.withColumn("width", F.least(F.size("__tokens"), F.lit(WINDOW))).filter(F.col("width") >= LITERALS)
    plain = materialise(plain, "bench_verbatim")
    widths = sorted(r["width"] for r in plain.select("width").distinct().collect())  # from LITERALS to WINDOW
    said = texts.select("doc_id", tokens(F.lower(F.coalesce("text", F.lit("")))).alias("__tokens"))
    out = None
    for width in widths:
        own = windows(plain.filter(F.col("width") == width).select("item", "__tokens").distinct(), "item", width=width)
        own = materialise(own.withColumnRenamed("pos", "ipos"), "bench_verbatim_windows")
        counts = own.groupBy("item").agg(F.countDistinct("hash").alias("item_windows"))
        rows = (
            windows(said, "doc_id", width=width)
            .join(broadcast_if_small(own.groupBy("item", "hash").agg(F.min("ipos").alias("ipos"))), "hash")
            .groupBy("doc_id", "item", (F.col("pos") - F.col("ipos")).alias("shift"))
            .agg(F.countDistinct("ipos").alias("windows"))
            .join(counts, "item")
            .filter(F.col("windows") >= F.least(F.lit(RUN), F.col("item_windows")))
            .join(plain.select("item", "item_id"), "item")
            .select(
                "doc_id", "item_id", "windows", "item_windows", F.lit(0).alias("slots"), F.lit(False).alias("reparameterised")
            )
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, passages, windows, item_windows, slots, reparameterised): one row per document and item."""
    found = find_passages(docs.select(document_key().alias("doc_id"), "text"), benchmark)
    whole = found.groupBy("doc_id", "item_id").agg(
        F.count(F.lit(1)).alias("passages"),
        F.max("windows").alias("windows"),
        F.max("item_windows").alias("item_windows"),
        F.max("slots").alias("slots"),
        F.min("reparameterised").alias("reparameterised"),
    )
    named = F.when(F.col("doc_id").startswith("d"), F.substring("doc_id", 2, 40).cast("long"))
    return whole.withColumn("doc_id", named)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a passage of the benchmark."""
    keyed = docs.withColumn("__document", document_key())
    found = find_passages(keyed.select(F.col("__document").alias("doc_id"), "text"), benchmark)
    gone = materialise(found.select(F.col("doc_id").alias("__document")).distinct(), "bench_gone")
    return keyed.join(broadcast_if_small(gone), "__document", "left_anti").select(*docs.columns)
