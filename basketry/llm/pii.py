"""Personal data: overlapping candidates, boosted trees on format and context, calibrated thresholds.

High-recall generators propose spans in every whole text: the four base patterns (email, ip, card, phone) and looser forms
of addresses and digit runs, and the single groups of joined runs, which may overlap.  Base matches that pass their checks
are always redacted.  Boosted trees learn how such data looks and what stands around it.  Right for them are checked base
spans, what overlaps one of its kind, undivided or oddly divided runs that pass a card's checksum, and addresses written
with ``(at)``; wrong is what fails its check or has none.  Loose phone numbers that stand behind a word for a phone are
neither, and only judged.  The leading plus is no feature, so that phones are found without it.  On candidates held back, each kind's threshold is the least score above which ``PRECISION`` of them
are right; other candidates at or above it are added where they overlap no base span (of overlapping ones the leftmost).
Every distinct candidate with a label takes part: three quarters of them, by a hash of their text, fit the trees, and the
others set the thresholds.

Positions are code points, ends exclusive.  Null or empty texts have no spans; repeated rows are each returned; without
candidates of both classes nothing is added; an empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import materialise

KINDS = ("email", "ip", "card", "phone")
PRECISION, BINS, CONTEXT = 0.98, 50, 24

_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: Patterns by generator, and a character class without which a text has no match.  They take the same matches as the
#: plain forms of the contract; possessive repeats and the look at the character before keep long runs linear.
GENERATORS = {
    "email": (rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", "[0-9]"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", "[0-9]"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+"),
    "loose_email": (
        rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++\x20?(?:@|\(at\)|\[at\])\x20?{_LABEL}++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?{_LABEL}++)*+",
        r"@|[(\[]at[)\]]",
    ),
    "digits": (r"\(?[0-9](?:[\x20().\-/]{0,2}[0-9]){6,}+", "[0-9]"),
    "group": (r"(?<![0-9])[0-9]{14,19}+(?![0-9])", "[0-9]{14}"),
}
#: An address that hides its sign, and words before a phone number.
_HIDDEN, _PHONE_WORDS = r"(?i)[(\[]at[)\]].*(\.|[(\[]dot[)\]])\x20?[a-z]{2,}$", "phone|tel|call|mobile|cell|fax"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
FEATURES = (
    "length", "n_digits", "n_marks", "n_letters", "n_at", "n_dots", "n_groups", "n_kinds", "longest", "before_kind", "after_kind",
    "quoted", "assigned", "checksum", "hidden", "named_email", "named_ip", "named_card", "named_phone", "is_email", "is_ip", "is_card", "is_phone",
)


def _matches(text: Column, generator: str) -> tuple[Column, Column]:
    """The gaps between a generator's matches, and the matches; null if the text cannot have any."""
    pattern, need = GENERATORS[generator]
    some = text.rlike(need)
    return F.when(some, F.split(text, pattern, -1)), F.when(some, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def _match(generator: str):
    """Lambda from a match's number to its struct."""
    gaps, found = F.col(f"gaps_{generator}"), F.col(f"found_{generator}")
    return lambda i: F.struct(
        F.lit(generator).alias("gen"),
        i.alias("idx"),
        F.length(F.get(gaps, i)).cast("long").alias("gap"),
        F.get(found, i).alias("value"),
        F.right(F.get(gaps, i), F.lit(CONTEXT)).alias("before"),
        F.left(F.get(gaps, i + 1), F.lit(CONTEXT)).alias("after"),
    )


def candidates(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, gen, idx, gap, value, before, after): all generators' matches; a text without any has one null row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    every = []
    for g in GENERATORS:
        gaps, found = _matches(F.col("text"), g)
        out = out.withColumn(f"gaps_{g}", gaps).withColumn(f"found_{g}", found)
    for g in GENERATORS:
        some = F.size(f"found_{g}") > 0
        every.append(F.when(some, F.transform(F.sequence(F.lit(0), F.size(f"found_{g}") - 1), _match(g))))
    none = F.array().cast("array<struct<gen: string, idx: int, gap: bigint, value: string, before: string, after: string>>")
    joined = F.concat(*(F.coalesce(c, none) for c in every))
    return out.select("uid", "doc_id", joined.alias("all")).select("uid", "doc_id", F.explode_outer("all").alias("c")).select(
        "uid", "doc_id", "c.*"
    )


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the checksum."""
    rev = F.reverse(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(rev, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def spans(found: DataFrame) -> DataFrame:
    """``found`` with start, end, kind, ``base`` (a checked match of a base pattern), and ``digits``."""
    order = Window.partitionBy("uid", "gen").orderBy("idx")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.length("value").cast("long")
    end = F.sum(F.col("gap") + n).over(upto)
    digits = F.regexp_replace("value", "[^0-9]", "")
    count = F.length("digits")
    checked = (
        F.when(F.col("gen") == "email", True)
        .when(F.col("gen") == "ip", F.col("value").rlike(rf"^(?:{_BYTE}\.){{3}}{_BYTE}$"))
        .when(F.col("gen") == "card", F.when(count.between(14, 19), luhn(F.col("digits"))).otherwise(False))
        .when(F.col("gen") == "phone", count.between(10, 15))
        .otherwise(False)
    )
    kind = (
        F.when(F.col("gen").isin(*KINDS), F.col("gen"))
        .when(F.col("gen") == "loose_email", "email")
        .when(F.col("gen") == "group", "card")
        .otherwise(F.when(count >= 13, "card").otherwise("phone"))
    )
    return (
        found.filter("gen is not null")
        .withColumn("end", end)
        .withColumn("start", F.col("end") - n)
        .withColumn("digits", digits)
        .withColumn("base", checked)
        .withColumn("kind", kind)
        .drop("gap", "idx")
    )


def _checksum() -> Column:
    """Whether the digits are as many as a card's and pass its checksum."""
    return F.when(F.length("digits").between(14, 19), luhn(F.col("digits"))).otherwise(False)


def _label() -> Column:
    """1 for right, 0 for wrong, null for candidates that are only judged."""
    n = F.length("digits")
    right = F.col("base") | F.col("same") | (F.col("gen").isin("digits", "group") & _checksum())
    right = right | ((F.col("gen") == "loose_email") & F.col("value").rlike(_HIDDEN))
    open_phone = (F.col("gen") == "digits") & n.between(10, 15) & F.lower("before").rlike(_PHONE_WORDS)
    return F.when(right, 1.0).when(~open_phone, 0.0)


def _overlaps_base(name: str, *keys: str) -> tuple[str, Column]:
    """Whether a row overlaps another row that is a base span, among the rows with equal keys."""
    first = Window.partitionBy(*keys).orderBy("start", F.desc("base"), "end", "gen")
    last = Window.partitionBy(*keys).orderBy(F.desc("start"), "base", F.desc("end"), F.desc("gen"))
    before = F.max(F.when(F.col("base"), F.col("end"))).over(first.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(F.col("base"), F.col("start"))).over(last.rowsBetween(Window.unboundedPreceding, -1))
    return name, F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(after < F.col("end"), F.lit(False))


def _char_kind(c: Column) -> Column:
    return (
        F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike("[0-9]"), 2).when(c.rlike(r"\p{L}"), 3)
        .when(c.isin('"', "'"), 4).otherwise(5)
    ).cast("double")


def features(df: DataFrame) -> DataFrame:
    """``df`` with the vector ``x`` of its rows' format and context."""
    v, near = F.regexp_replace("value", r"^\+", ""), F.lower(F.col("before"))
    groups = F.split(v, "[^0-9A-Za-z]+")
    columns = {
        "length": F.length(v),
        "n_digits": F.length("digits"),
        "n_marks": F.length(F.regexp_replace(v, r"[\p{L}\p{N}]", "")),
        "n_letters": F.length(F.regexp_replace(v, r"[^\p{L}]", "")),
        "n_at": F.size(F.split(v, "@")) - 1,
        "n_dots": F.size(F.split(v, r"\.")) - 1,
        "n_groups": F.size(groups),
        "n_kinds": F.size(F.array_distinct(F.split("digits", ""))),
        "longest": F.array_max(F.transform(groups, lambda g: F.length(g))),
        "before_kind": _char_kind(F.right("before", F.lit(1))),
        "after_kind": _char_kind(F.left("after", F.lit(1))),
        "quoted": F.right("before", F.lit(1)).isin('"', "'"),
        "assigned": near.rlike(r"[=:]\s*[\"']?$"),
        "checksum": _checksum(),
        "hidden": F.col("value").rlike(_HIDDEN),
        "named_email": near.rlike("mail|contact|write|from|to:"),
        "named_ip": near.rlike(r"\bip\b|host|server|addr|login"),
        "named_card": near.rlike("card|visa|credit|payment|iban|account"),
        "named_phone": near.rlike(_PHONE_WORDS),
        **{f"is_{k}": F.col("kind") == k for k in KINDS},
    }
    df = df.withColumns({f"f_{k}": F.coalesce(c.cast("double"), F.lit(0.0)) for k, c in columns.items()})
    names = [f"f_{k}" for k in FEATURES]
    return VectorAssembler(inputCols=names, outputCol="x").transform(df).drop(*names)


def fit_trees(labelled: DataFrame):
    """The trees and the thresholds by kind, or None without candidates of both classes."""
    # copies count once: a passage of a third of all rows must not outweigh the others
    labelled = labelled.filter("y is not null").select("gen", "kind", "value", "before", "after", "digits", "y").distinct()
    every = labelled.withColumn("held", F.pmod(F.xxhash64(F.lit("held"), "value"), F.lit(4)) == 0)
    every = materialise(features(every).select("kind", "y", "x", "held"), "pii_fit")
    train = every.filter("not held")
    low, high = train.agg(F.min("y"), F.max("y")).first()
    if low is None or low == high:
        return None
    model = GBTClassifier(
        featuresCol="x", labelCol="y", maxIter=10, maxDepth=4, stepSize=0.3, seed=10, cacheNodeIds=False
    ).fit(train)
    held = scored(model, every.filter("held"))
    bins = (
        held.withColumn("bin", F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).cast("int"))
        .groupBy("kind", "bin")
        .agg(F.sum("y").alias("right"), F.count(F.lit(1)).alias("all"))
        .collect()  # BINS rows a kind at most
    )
    thresholds = {}
    for kind in KINDS:
        right = total = 0.0
        for r in sorted((r for r in bins if r["kind"] == kind), key=lambda r: -r["bin"]):
            right, total = right + r["right"], total + r["all"]
            if right < PRECISION * total:
                break
            if total >= 10:
                thresholds[kind] = r["bin"] / BINS
    return model, thresholds


def scored(model, df: DataFrame) -> DataFrame:
    out = model.setProbabilityCol("__p").setRawPredictionCol("__raw").setPredictionCol("__label").transform(df)
    return out.withColumn("score", vector_to_array("__p")[1]).drop("__p", "__raw", "__label")


def find_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(uid, doc_id) of every row, and (uid, kind, start, end, base, value, score) of its redacted spans."""
    found = materialise(candidates(docs), "pii_candidates")
    marked = spans(found).withColumn(*_overlaps_base("same", "uid", "kind")).withColumn(*_overlaps_base("covered", "uid"))
    marked = materialise(marked.withColumn("y", _label()), "pii_spans")
    kept = ["uid", "kind", "start", "end", "base", "value"]
    base = marked.filter("base").select(*kept, F.lit(1.0).alias("score"))
    fitted = fit_trees(marked)
    ids = found.select("uid", "doc_id").distinct()
    if fitted is None or not fitted[1]:
        return ids, base
    model, thresholds = fitted
    limit = reduce(lambda c, k: c.when(F.col("kind") == k, thresholds.get(k, 2.0)), KINDS, F.when(F.lit(False), 2.0))
    more = scored(model, features(marked.filter("not base and not covered"))).filter(F.col("score") >= limit.otherwise(2.0))
    left = Window.partitionBy("uid").orderBy("start", F.desc("end"), "gen").rowsBetween(Window.unboundedPreceding, -1)
    free = F.coalesce(F.max("end").over(left) <= F.col("start"), F.lit(True))
    more = more.withColumn("free", free).filter("free")
    return ids, base.unionByName(more.select(*kept, "score"))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added of every document."""
    ids, redacted = find_spans(docs)
    rank = reduce(lambda c, i: c.when(F.col("kind") == KINDS[i], i), range(len(KINDS)), F.when(F.lit(False), 9)).otherwise(9)
    item = F.struct("start", rank.alias("rank"), "end", "kind", "base")
    grouped = redacted.groupBy("uid").agg(F.array_sort(F.collect_list(item)).alias("all"))
    shown = lambda array: F.array_join(
        F.transform(array, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    none = F.array().cast("array<struct<start: bigint, rank: int, end: bigint, kind: string, base: boolean>>")
    every = ids.join(grouped, "uid", "left").withColumn("all", F.coalesce("all", none))
    every = every.withColumn("certain", F.filter("all", lambda s: s["base"]))
    number = lambda k: F.size(F.filter("certain", lambda s: s["kind"] == k))
    counts = [number(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return every.select(
        "doc_id",
        *counts,
        F.sha2(shown(F.col("certain")), 256).alias("base_sha256"),
        shown(F.col("all")).alias("spans"),
        (F.size("all") - F.size("certain")).cast("long").alias("n_added"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the texts with every span replaced by its kind in brackets (overlapping spans by the first's)."""
    ids, redacted = find_spans(docs)
    left = Window.partitionBy("uid").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    runs = redacted.withColumn("from", F.greatest("start", F.coalesce(F.max("end").over(left), F.lit(0)))).filter("from < end")
    cuts = runs.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("from", "end", "kind", "start"))).alias("cuts"))
    texts = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    piece = lambda acc, c: F.struct(
        F.concat(
            acc["out"],
            F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (c["from"] - acc["at"]).cast("int")),
            F.when(c["from"] == c["start"], F.concat(F.lit("["), c["kind"], F.lit("]"))).otherwise(F.lit("")),
        ).alias("out"),
        c["end"].alias("at"),
    )
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    done = lambda acc: F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text")))
    return texts.join(cuts, "uid", "left").select(
        "doc_id", F.when(F.col("cuts").isNull(), F.col("text")).otherwise(F.aggregate("cuts", start, piece, done)).alias("text")
    )
