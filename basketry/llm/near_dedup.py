"""MinHash near-duplicates from bottom-k sketches of one hash function.

1. A document's set: the 64-bit hashes of its distinct word shingles (A-Z lower-cased); its sketch: the k least of them.
   Documents with equal sets form a class, and one representative goes on, so exact copies are never compared.
2. Inverted lists of retained values generate overlaps.  A linked pair shares at least ``overlap(m)`` of its sketch
   values, so only each sketch's rarest ``m - overlap(m) + 1`` values are indexed: passages that many documents share
   fill no list unless they make up a document.
3. Pairs from the lists are filtered by size and by the resemblance estimated from the union's sketch (4.5 standard
   deviations below the threshold), then verified by exact Jaccard on full sets.
4. Long lists are not expanded to all pairs: each member meets the list's pivot, first the member with most of what
   the others have, lists whose members got into one component are done, and further pivots follow while each takes off a fifth of
   the open pairs.  Members of the lists still open are then indexed by their full sets, as far as a link needs it, and
   meet where sizes and places of the shared value leave room for one.  So any linked pair that shares a list is either
   compared or already connected.

Documents without words have an empty set and are linked with nothing.  Rows that share a doc_id are one document: they
are linked if any of their texts is.  Null ids get a null component and are kept.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import ascii_lower, broadcast_if_small, materialise, words
from basketry.llm.components import connected_components

SKETCH = 64
#: What a value of one document alone takes off the logarithms of the other values' frequencies, in the choice of pivots.
OWN = 8.0


def shingle_hashes(tokens: Column, n: int) -> Column:
    """Hashes of all n-word shingles; a shorter text is one shingle, no words give none."""
    at = lambda i: F.xxhash64(*(F.get(tokens, i + j) for j in range(n)))
    return (
        F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(0), F.size(tokens) - n), at))
        .when(F.size(tokens) > 0, F.array(F.xxhash64(F.array_join(tokens, " "))))
        .otherwise(F.array().cast("array<bigint>"))
    )


def shingle_sets(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, hashes): the sorted distinct shingle hashes of every whole text."""
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), words(ascii_lower(F.col("text"))).alias("tokens"))
        .select("doc_id", shingle_hashes(F.col("tokens"), n).alias("hashes"))
        .select("doc_id", F.sort_array(F.array_distinct("hashes")).alias("hashes"))
    )


def sketches(docs: DataFrame, n: int, k: int) -> DataFrame:
    """(doc_id, n_shingles, key_a, key_b, sketch): keys are a 128-bit digest of the whole set."""
    return shingle_sets(docs, n).select(
        "doc_id",
        F.size("hashes").cast("long").alias("n_shingles"),
        F.xxhash64("hashes").alias("key_a"),
        F.xxhash64(F.lit(7), "hashes").alias("key_b"),
        F.slice("hashes", 1, k).alias("sketch"),
    )


def _cutoff(percent: int, k: int) -> float:
    p = percent / 100
    return max(0.05, p - 4.5 * math.sqrt(p * (1 - p) / k))


def rare_entries(reps: DataFrame, cutoff: float) -> DataFrame:
    """(value, id, n): the indexed values of every sketch, the rarest first, as far as two documents share them."""
    values = reps.select("id", "n", F.size("sketch").alias("m"), F.explode("sketch").alias("value"))
    shared = values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    # values of one document alone come first in its order and only count: m - kept of them
    logs = lambda acc, e: acc + F.log(e["df"])
    return (
        values.join(shared, "value")
        .groupBy("id", "n", "m")
        .agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("kept"))
        .withColumn("prefix", F.col("m") - F.ceil(F.col("m") * cutoff - 1e-9) + 1)
        .withColumn("room", (F.col("prefix") - (F.col("m") - F.size("kept"))).cast("int"))
        .filter("room > 0")
        .withColumn("common", (F.aggregate("kept", F.lit(0.0), logs) - OWN * (F.col("m") - F.size("kept"))) * F.col("n") / F.col("m"))
        .select("id", "n", "common", F.explode(F.slice("kept", F.lit(1), F.col("room"))).alias("entry"))
        .select(F.col("entry.value").alias("value"), "id", "n", "common")
    )


def room_entries(sets: DataFrame, percent: int) -> DataFrame:
    """(id, component, n, first, at, value): the values of full sets that can be a linked pair's first common one.

    With the rarest values first, a linked pair's first common value lies in the first ``n - 2 * percent * n /
    (100 + percent) + 1`` values of the smaller set and the first ``n - percent * n / 100 + 1`` of the larger, and at
    least the overlap that the link needs must follow it in both.
    """
    values = sets.select("id", "component", "n", "key", F.explode("hashes").alias("value"))
    shared = values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    least = lambda top, bottom: F.ceil(F.col("n") * top / F.lit(bottom) - 1e-9)
    entries = (
        values.join(shared, "value")
        .groupBy("id", "component", "n", "key")
        .agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("kept"))
        .withColumn("own", F.col("n") - F.size("kept"))
        .withColumn("room", (F.col("n") - least(percent, 100) + 1 - F.col("own")).cast("int"))
        .filter("room > 0")
        .withColumn("first", F.col("n") - least(2 * percent, 100 + percent) + 1)
        .select("id", "component", "n", "own", "first", F.posexplode(F.slice("kept", F.lit(1), F.col("room"))).alias("pos", "entry"))
        .select("id", "component", "n", "first", (F.col("own") + F.col("pos")).alias("at"), F.col("entry.value").alias("value"))
    )
    return materialise(entries, "nd_room")


def room_pairs(entries: DataFrame, percent: int, pivots: bool = False) -> DataFrame:
    """Pairs (a, b) of different components that have room for a link; ``pivots``: with each list's foremost set only."""
    if pivots:
        foremost = F.min(F.struct(F.col("at") / F.col("n"), "id", "component", "n", "first", "at")).alias("p")
        x = entries.filter("at < first").groupBy("value").agg(foremost).select("value", "p.*").alias("x")
        y, ordered = entries.alias("y"), F.col("x.id") != F.col("y.id")
    else:
        x, y = entries.filter("at < first").alias("x"), entries.alias("y")
        ordered = F.struct("x.n", "x.id") < F.struct("y.n", "y.id")
    follow = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    fits = F.lit(100 + percent) * follow >= F.lit(percent) * (F.col("x.n") + F.col("y.n"))
    different = F.col("x.component") != F.col("y.component")
    return (
        x.join(y, (F.col("x.value") == F.col("y.value")) & ordered & different & fits)
        .select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
        .distinct()
    )


class _Verifier:
    """Turns candidate pairs into links: union-sketch estimate, then exact Jaccard."""

    def __init__(self, reps: DataFrame, sets: DataFrame, percent: int, k: int):
        self.reps, self.sets, self.percent, self.k = reps, sets, percent, k

    def links(self, pairs: DataFrame) -> DataFrame:
        side = lambda df, column, s: df.select(F.col("id").alias(s), F.col(column).alias(f"{column}_{s}"))
        union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, self.k)
        both = F.array_intersect(F.array_intersect("union", "sketch_a"), "sketch_b")
        likely = (
            pairs.join(side(self.reps, "sketch", "a"), "a")
            .join(side(self.reps, "sketch", "b"), "b")
            .withColumn("union", union)
            .filter(F.size(both) >= F.size("union") * _cutoff(self.percent, self.k) - 1e-9)
            .select("a", "b")
        )
        common = F.size(F.array_intersect("hashes_a", "hashes_b"))
        total = F.size("hashes_a") + F.size("hashes_b") - common
        return (
            materialise(likely.distinct(), "nd_likely")
            .join(side(self.sets, "hashes", "a"), "a")
            .join(side(self.sets, "hashes", "b"), "b")
            .filter(100 * common >= self.percent * total)
            .select("a", "b")
        )


def _fit(n: Column, other: Column, percent: int) -> Column:
    return (F.lit(100) * F.least(n, other) >= F.lit(percent) * F.greatest(n, other))


def class_links(reps: DataFrame, docs: DataFrame, n: int, percent: int, k: int) -> DataFrame:
    """Links (a, b) between representatives that connect all of each component."""
    entries = materialise(rare_entries(reps, _cutoff(percent, k)), "nd_entries")
    lists = entries.groupBy("value").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("value")
    entries = materialise(entries.join(lists, "value"), "nd_lists")
    active = materialise(entries.select("id").distinct(), "nd_active")
    wanted = docs.join(broadcast_if_small(active), docs["doc_id"] == active["id"], "left_semi")
    sets = shingle_sets(wanted, n).dropDuplicates(["doc_id", "hashes"]).withColumnRenamed("doc_id", "id")
    # size and key are written, or they would be computed for each value that room_pairs makes of a set
    sets = materialise(
        sets.withColumn("n", F.size("hashes").cast("long")).withColumn("key", F.xxhash64("hashes")), "nd_sets"
    )
    verifier = _Verifier(reps, sets, percent, k)
    total = entries.count()
    found, stars, turn, before = None, None, 0, math.inf
    placed = entries.withColumn("component", F.col("id"))
    while True:
        if found is not None:
            component = connected_components(found)
            # a link from each member to its component's least id says the same as all links so far
            stars = component.filter("id != component").select(F.col("id").alias("a"), F.col("component").alias("b"))
            placed = (
                entries.join(component, "id", "left")
                .withColumn("component", F.coalesce("component", "id"))
            )
            mixed = (
                placed.groupBy("value").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
                .filter("lo != hi").select("value")
            )
            placed = materialise(placed.join(mixed, "value"), "nd_open")
            by_part = placed.groupBy("value", "component").agg(F.count(F.lit(1)).cast("double").alias("m"))
            by_list = by_part.groupBy("value").agg((F.pow(F.sum("m"), 2) - F.sum(F.col("m") * F.col("m"))).alias("p"))
            left = (by_list.agg(F.sum("p")).first()[0] or 0.0) / 2
            if left == 0:
                return stars
            if left <= 8 * total or left > 0.8 * before:
                break
            before = left
        turn += 1
        first = -F.col("common") if turn == 1 else F.lit(0.0)
        pivots = (
            placed.groupBy("value")
            .agg(F.min(F.struct(first.alias("first"), F.xxhash64("id", F.lit(turn)), "id", "n", "component")).alias("p"))
        )
        pairs = (
            placed.join(pivots, "value")
            .filter(F.col("component") != F.col("p.component"))
            .filter(_fit(F.col("n"), F.col("p.n"), percent))
            .select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b"))
            .distinct()
        )
        new = materialise(verifier.links(pairs), "nd_links")
        found = new if stars is None else stars.union(new)
    room = room_entries(sets.join(placed.select("id", "component").distinct(), "id"), percent)
    new = materialise(verifier.links(room_pairs(room, percent, pivots=True)), "nd_links")
    component = connected_components(stars.union(new))
    stars = component.filter("id != component").select(F.col("id").alias("a"), F.col("component").alias("b"))
    room = room.drop("component").join(component, "id", "left").withColumn("component", F.coalesce("component", "id"))
    rest = room_pairs(materialise(room, "nd_room_open"), percent)
    return stars.union(materialise(verifier.links(rest), "nd_rest"))


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, k: int = SKETCH) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row: groups of documents linked by Jaccard >= percent / 100."""
    docs = docs.select("doc_id", "text")
    members = materialise(sketches(docs, n, k), "nd_sketches")
    classes = materialise(
        members.filter("n_shingles > 0 and doc_id is not null")
        .groupBy("key_a", "key_b", "n_shingles")
        .agg(F.min("doc_id").alias("id")),
        "nd_classes",
    )
    keyed = members.select(F.col("doc_id").alias("id"), "key_a", "key_b", F.col("n_shingles").alias("n"), "sketch")
    reps = materialise(
        keyed.join(classes, ["id", "key_a", "key_b"]).select("id", "n", "sketch").distinct(), "nd_reps"
    )
    links = class_links(reps, docs, n, percent, k)
    # the rows of a doc_id and the class of each text hang together as well
    same = members.join(classes, ["key_a", "key_b", "n_shingles"]).select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    several = members.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1 and doc_id is not null").select("doc_id")
    extra = same.join(several, F.col("a") == F.col("doc_id"), "left_semi")
    component = connected_components(links.union(extra)).select(F.col("id").alias("of"), "component")
    return (
        members.select("doc_id", "n_shingles", "key_a", "key_b")
        .join(classes, ["key_a", "key_b", "n_shingles"], "left")
        .join(component, F.col("id") == F.col("of"), "left")
        .withColumn("component_id", F.coalesce("component", "id", "doc_id"))
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    )


def deduplicate(docs: DataFrame, n: int = 5, percent: int = 80, k: int = SKETCH) -> DataFrame:
    """``docs`` without all but one document, that of the smallest doc_id, of each group."""
    gone = near_duplicates(docs, n, percent, k).filter(~F.col("kept")).select("doc_id").distinct()
    gone = materialise(gone, "nd_gone")
    return docs.join(broadcast_if_small(gone), "doc_id", "left_anti").select(*docs.columns)
