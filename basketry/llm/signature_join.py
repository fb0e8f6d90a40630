"""N-gram Jaccard join by signature trees.

1. Documents with equal sets of word shingles form a class; classes are joined.  In a linked pair at least ``percent`` of
   either set is shared, so a class goes on only if so much of its set occurs in other classes (first judged on the
   quarter of the shingles with the least hashes, where the missing ones weigh four times as much, then on all when
   its rarest shingles are looked for).  Only (shingle, class) rows are shuffled for that, never the sets.
2. Signature trees: classes in the order of a min-hash are cut to trees of at most ``TREE`` classes.  A node holds the
   OR of its members' token bitmaps, their range of sizes and the greatest number of tokens beyond set bits.  Dual
   traversal goes down from pairs of nodes whose sizes fit and whose common bits leave room for the overlap a link needs;
   classes that hang together already are not met again; what is left is verified on the full sets.
3. Trees are built anew over other min-hashes, from the classes that are still open, as long as that helps.  A class is
   open if one of its rarest shingles, of which a linked pair must share one, is held by another component's class.
4. The holders of each shingle that is still open are made a tree and traversed; those of a frequent one are cut to several
   trees, of which the largest component's meet only the others'.  So every linked pair is either verified or connected
   before, and no shingle's holders are gathered in one task.

Documents without words have an empty set and are linked with nothing.  Rows that share a doc_id are one document: linked
if any of their texts is.  Null ids get a null component and are linked with nothing.  Repeated rows are kept.  An empty
table gives an empty result; other columns take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import ascii_lower, broadcast_if_small, materialise, words
from basketry.llm.components import connected_components

TREE, FANOUT = 1024, 8
#: A tree also ends at so many shingles (8 bytes each); bitmaps compared at once, in bytes; pairs between two looks at what hangs together.
TREE_SHINGLES, AT_ONCE, STEP = 1 << 21, 1 << 25, 1 << 14


def shingle_sets(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, hashes): sorted distinct hashes of the n-word shingles of every whole text; fewer words are one shingle."""
    tokens = F.col("tokens")
    at = lambda i: F.xxhash64(*(F.get(tokens, i + j) for j in range(n)))
    hashes = (
        F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(0), F.size(tokens) - n), at))
        .when(F.size(tokens) > 0, F.array(F.xxhash64(F.array_join(tokens, " "))))
        .otherwise(F.array().cast("array<bigint>"))
    )
    worded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words(ascii_lower(F.col("text"))).alias("tokens"))
    return worded.select("doc_id", F.array_sort(F.array_distinct(hashes)).alias("hashes"))


def _keys(sets: DataFrame) -> DataFrame:
    """``sets`` with the size and a 128-bit digest of the whole set."""
    return sets.withColumns(
        {"n": F.size("hashes").cast("long"), "key_a": F.xxhash64("hashes"), "key_b": F.xxhash64(F.lit(7), "hashes")}
    )


def _missing(n: Column, percent: int) -> Column:
    """How many of a set's ``n`` tokens a linked set can lack."""
    return n - F.ceil(n * percent / F.lit(100) - 1e-9)


def _supported(tokens: DataFrame) -> DataFrame:
    """(uid, common): how many tokens of each class occur in others as well; ``tokens``: uid, value."""
    shared = tokens.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1").select("value")
    return tokens.join(shared, "value").groupBy("uid").agg(F.count(F.lit(1)).alias("common"))


def joinable_sets(docs: DataFrame, classes: DataFrame, members: DataFrame, n: int, percent: int) -> DataFrame:
    """(uid, n, hashes) of the classes that can be linked with another one, as far as the quarter of their sets shows it."""
    quarter = members.withColumnRenamed("row", "uid").join(broadcast_if_small(classes.select("uid")), "uid", "left_semi")
    # 40 bits of a hash tell whether a token may be shared: two hashes that agree in them only let more classes go on
    sampled = quarter.select("uid", F.explode("quarter").alias("hash")).select("uid", F.col("hash").bitwiseAND(F.lit((1 << 40) - 1)).alias("value"))
    looked = quarter.select("uid", F.col("held") - _missing(F.col("n"), percent))
    looked = looked.toDF("uid", "least")
    # sets without a token in the quarter, or that can lack all they have there, go on
    enough = _supported(sampled).join(looked, "uid").filter("common >= least").select("uid")
    first = materialise(enough.union(looked.filter("least <= 0").select("uid")).distinct(), "sj_first")
    wanted = materialise(classes.join(broadcast_if_small(first), "uid", "left_semi"), "sj_wanted")

    def sets_of(some: DataFrame) -> DataFrame:
        texts = docs.join(broadcast_if_small(some.select("doc_id").distinct()), "doc_id", "left_semi")
        keyed = _keys(shingle_sets(texts, n)).join(broadcast_if_small(some), ["doc_id", "n", "key_a", "key_b"])
        return keyed.select("uid", "n", "hashes")

    # only sets that several rows of their class's first document have are shuffled, to keep one of them
    once, repeated = wanted.filter("copies = 1"), wanted.filter("copies > 1")
    return materialise(sets_of(once).union(sets_of(repeated).dropDuplicates(["uid"])), "sj_sets")


class _Forest:
    """A union-find over the members of one task, and signature trees over parts of them."""

    def __init__(self, component: np.ndarray, sets: list[np.ndarray], percent: int):
        self.sets, self.percent = sets, percent
        _, first, back = np.unique(component, return_index=True, return_inverse=True)
        self.parent = first[back]
        self.size = np.array([len(s) for s in sets], np.int64)
        # some 16 bits a token of the largest set
        bits = 1 << min(16, max(10, int(self.size.max(initial=1)).bit_length() + 4))
        packed = np.zeros((len(sets), bits // 8), np.uint8)
        for i, s in enumerate(sets):
            at = s & (bits - 1)
            np.bitwise_or.at(packed[i], at >> 3, (1 << (at & 7)).astype(np.uint8))
        self.bits = packed.view(np.uint64)
        self.beyond = self.size - np.bitwise_count(self.bits).sum(1).astype(np.int64)

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def roots(self) -> np.ndarray:
        up = self.parent
        while True:
            further = up[up]
            if (further == up).all():
                return up
            up = further

    def tree(self, members: np.ndarray) -> list[tuple]:
        """Levels from the members up to one node: (OR bitmap, least size, greatest size, tokens beyond bits, least and greatest root)."""
        root = self.roots()[members]
        size = self.size[members]
        levels = [(self.bits[members], size, size, self.beyond[members], root, root)]
        while len(levels[-1][1]) > 1:
            low = levels[-1]
            starts = np.arange(0, len(low[1]), FANOUT)
            ways = (np.bitwise_or, np.minimum, np.maximum, np.maximum, np.minimum, np.maximum)
            levels.append(tuple(way.reduceat(column, starts, 0) for way, column in zip(ways, low)))
        return levels

    def _fits(self, x: tuple, y: tuple, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether a node pair can hold a link between classes that do not hang together yet."""
        p = self.percent
        fits = (100 * x[2][i] >= p * y[1][j]) & (100 * y[2][j] >= p * x[1][i])
        fits &= ~((x[4][i] == x[5][i]) & (y[4][j] == y[5][j]) & (x[4][i] == y[4][j]))
        at = np.flatnonzero(fits)
        step = max(1, AT_ONCE // (8 * x[0].shape[1]))
        for k in range(0, len(at), step):
            part = at[k : k + step]
            a, b = i[part], j[part]
            common = np.bitwise_count(x[0][a] & y[0][b]).sum(1).astype(np.int64) + np.minimum(x[3][a], y[3][b])
            fits[part] = (100 + p) * common >= p * (x[1][a] + y[1][b])
        return fits

    def traverse(self, mine: np.ndarray, others: np.ndarray | None = None) -> None:
        """Join what links between ``mine`` and ``others`` (None: among ``mine``) connect."""
        if not len(mine) or (others is not None and not len(others)):
            return
        x = self.tree(mine)
        y = x if others is None else self.tree(others)
        # the trees may differ in height: the lower one's top waits
        height = max(len(x), len(y))
        stack = [(height - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, i, j = stack.pop()
            a, b = x[min(level, len(x) - 1)], y[min(level, len(y) - 1)]
            if level == 0:
                self._verify(mine[i], (mine if others is None else others)[j])
                continue
            keep = self._fits(a, b, i, j)
            i, j = i[keep], j[keep]
            ci, cj = self._children(x, level, i), self._children(y, level, j)
            i2, j2 = (ci[:, :, None] + 0 * cj[:, None, :]).reshape(-1), (cj[:, None, :] + 0 * ci[:, :, None]).reshape(-1)
            ok = (i2 >= 0) & (j2 >= 0)
            if others is None:
                ok &= (i2 < j2) if level == 1 else (i2 <= j2)
            i2, j2 = i2[ok], j2[ok]
            for k in reversed(range(0, len(i2), STEP)):
                stack.append((level - 1, i2[k : k + STEP], j2[k : k + STEP]))

    @staticmethod
    def _children(tree: list[tuple], level: int, nodes: np.ndarray) -> np.ndarray:
        """Numbers one level down, -1 for none; above its top a tree stays where it is."""
        if level >= len(tree):
            return nodes[:, None]
        children = nodes[:, None] * FANOUT + np.arange(FANOUT)
        return np.where(children < len(tree[level - 1][1]), children, -1)

    def _verify(self, i: np.ndarray, j: np.ndarray) -> None:
        root = self.roots()
        leaf = (self.bits, self.size, self.size, self.beyond, root, root)
        keep = self._fits(leaf, leaf, i, j)
        for a, b in zip(i[keep].tolist(), j[keep].tolist()):
            ra, rb = self.root(a), self.root(b)
            if ra == rb:
                continue
            s, t = self.sets[a], self.sets[b]
            s, t = (s, t) if len(s) <= len(t) else (t, s)
            common = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())
            if 100 * common >= self.percent * (len(s) + len(t) - common):
                self.parent[max(ra, rb)] = min(ra, rb)


def _plant(percent: int):
    """The function that cuts sorted partitions to trees and joins each tree in itself."""

    def joined(tree: str, ids: list, components: list, sets: list) -> pd.DataFrame:
        forest = _Forest(np.array(components), sets, percent)
        forest.traverse(np.arange(len(ids)))
        return pd.DataFrame({"uid": ids, "tree": tree, "with": np.array(ids)[forest.roots()]})

    def plant(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, components, sets, held, tree = [], [], [], 0, None
        for batch in batches:
            for uid, component, hashes in zip(batch["uid"], batch["component"], batch["hashes"]):
                if ids and (len(ids) == TREE or held + len(hashes) > TREE_SHINGLES):
                    yield joined(tree, ids, components, sets)
                    ids, components, sets, held = [], [], [], 0
                tree = str(uid) if not ids else tree
                ids.append(uid)
                components.append(component)
                sets.append(hashes)
                held += len(hashes)
        if ids:
            yield joined(tree, ids, components, sets)

    return plant


def _meet(percent: int):
    """The function that traverses the lists of one bucket: trees in themselves, or one side's tree against the other's."""

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["component", "uid"])
        uid = group["uid"].to_numpy()
        forest = _Forest(group["component"].to_numpy(), list(group["hashes"]), percent)
        sides: dict[int, tuple[list, list]] = {}
        for i, lists in enumerate(group["lists"]):
            for entry in lists:
                sides.setdefault(entry["value"], ([], []))[entry["side"]].append(i)
        for mine, others in sides.values():
            # a list with one side alone is met in itself, unless it was cut
            cut = "/main/" in group["bucket"].iat[0] or _differ(group["bucket"].iat[0])
            forest.traverse(np.array(mine, np.int64), np.array(others, np.int64) if cut else None)
        found = pd.DataFrame({"a": uid, "b": uid[forest.roots()]})
        return found[found["a"] != found["b"]]

    return meet


def _differ(bucket: str) -> bool:
    """Whether a bucket of a cut list holds two different parts of it."""
    return "/rest/" in bucket and len(set(bucket.split("/")[2:])) == 2


def _rarest(sets: DataFrame, percent: int) -> DataFrame:
    """(value, uid): the shared shingles of every class among its rarest, of which it has in common with a linked class at least one."""
    values = sets.select("uid", F.explode("hashes").alias("value"))
    shared = values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    # shingles of one class alone come first in its order and are of no use
    return (
        values.join(shared, "value")
        .groupBy("uid")
        .agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("kept"))
        .join(broadcast_if_small(sets.select("uid", "n")), "uid")
        .withColumn("room", (_missing(F.col("n"), percent) + 1 - (F.col("n") - F.size("kept"))).cast("int"))
        .filter("room > 0")
        .select("uid", F.explode(F.slice("kept", F.lit(1), F.col("room"))).alias("entry"))
        .select(F.col("entry.value").alias("value"), "uid")
    )


def _open(entries: DataFrame, component: DataFrame) -> DataFrame:
    """(value, uid, component) of the entries whose shingle is held by several components."""
    placed = entries.join(component, "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    ends = placed.groupBy("value").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    return materialise(placed.join(ends.filter("lo != hi").select("value"), "value"), "sj_open")


def _open_pairs(opened: DataFrame) -> float:
    """How many pairs of different components share a shingle, counted once a shingle."""
    part = opened.groupBy("value", "component").agg(F.count(F.lit(1)).cast("double").alias("m"))
    return (part.groupBy("value").agg((F.pow(F.sum("m"), 2) - F.sum(F.col("m") * F.col("m"))).alias("p")).agg(F.sum("p")).first()[0] or 0.0) / 2


def link_classes(sets: DataFrame, percent: int) -> DataFrame:
    """(uid, component) of the classes that hang together with another one; ``sets``: uid, n, hashes."""
    spark = sets.sparkSession
    entries = materialise(_rarest(sets, percent), "sj_entries")
    component = spark.createDataFrame([], "uid long, component long")
    opened, turn, before = _open(entries, component), 0, math.inf
    while True:
        pairs = _open_pairs(opened)
        if pairs == 0:
            return component
        if turn and pairs > 0.5 * before:
            break
        before, turn = pairs, turn + 1
        # every open class with its least seeded hash, in whose order trees are cut
        active = opened.select("uid", "component").distinct()
        seeded = F.array_min(F.transform("hashes", lambda h: F.xxhash64(h, F.lit(turn))))
        ordered = sets.join(broadcast_if_small(active), "uid").select("uid", "component", seeded.alias("least"), "n", "hashes")
        ordered = ordered.repartitionByRange("least", "n", "uid").sortWithinPartitions("least", "n", "uid")
        trees = materialise(
            ordered.select("uid", "component", "hashes").mapInPandas(_plant(percent), "uid long, tree string, with long"), "sj_trees"
        )
        found = trees.filter("uid != with").select(F.col("uid").alias("a"), F.col("with").alias("b"))
        component = materialise(_merged(component, found), "sj_component")
        opened = _open(entries, component)
    still = sets.join(broadcast_if_small(opened.select("uid").distinct()), "uid", "left_semi")
    found = _lists_of_trees(opened, still).groupBy("bucket").applyInPandas(_meet(percent), "a long, b long")
    return materialise(_merged(component, materialise(found, "sj_found")), "sj_component")


def _lists_of_trees(opened: DataFrame, sets: DataFrame) -> DataFrame:
    """(bucket, uid, component, lists, hashes): the holders of open shingles, dealt to tasks; a list is (value, side).

    Shingles with equal holders are one list.  Lists that fit a tree go whole, some to a bucket.  Longer ones are cut: the
    members of the list's largest component hang together, so their parts meet only the parts of the others, and those
    meet each other.
    """
    held = opened.join(sets.select("uid", "n"), "uid")
    code = lambda salt: F.xxhash64("uid", F.lit(salt))
    lists = held.groupBy("value").agg(
        F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"), F.min("uid").alias("lo"),
        F.bit_xor(code(1)).alias("x"), F.sum(F.shiftright(code(2), 24)).alias("y"),
    )
    lists = lists.groupBy("size", "shingles", "lo", "x", "y").agg(F.min("value").alias("value"))
    parts = F.ceil(F.greatest(F.col("size") / TREE, F.col("shingles") / TREE_SHINGLES))
    lists = materialise(lists.select("value", "lo", "shingles", parts.alias("parts")), "sj_list")
    total = lists.filter("parts = 1").agg(F.sum("shingles")).first()[0] or 0
    near = F.pmod(F.xxhash64("lo", F.pmod("value", F.lit(16))), F.lit(max(1, -(-total // TREE_SHINGLES))))
    short = opened.join(lists.filter("parts = 1"), "value").select(
        near.cast("string").alias("bucket"), "value", F.lit(0).alias("side"), "uid", "component"
    )
    long = materialise(held.join(lists.filter("parts > 1").select("value", "parts"), "value"), "sj_long")
    by_part = long.groupBy("value", "component").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n"))
    largest = by_part.groupBy("value").agg(
        F.max(F.struct("m", "component")).alias("top"), F.sum("m").alias("size"), F.sum("n").alias("shingles"),
        F.max(F.struct("m", "component", "n"))["n"].alias("top_shingles"),
    )
    others = F.ceil(F.greatest((F.col("size") - F.col("top.m")) / TREE, (F.col("shingles") - F.col("top_shingles")) / TREE_SHINGLES))
    largest = largest.select("value", F.col("top.component").alias("largest"), F.greatest(others, F.lit(1)).alias("others"))
    placed = long.join(largest, "value").withColumn("main", F.col("component") == F.col("largest"))
    count = F.when(F.col("main"), F.col("parts")).otherwise(F.col("others"))
    placed = placed.withColumn("part", F.pmod(code(3), count))
    to = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    meet = lambda kind, lo, hi, side: F.struct(F.concat_ws("/", "value", F.lit(kind), lo.cast("string"), hi.cast("string")).alias("bucket"), side.cast("int").alias("side"))
    own = F.transform(to(F.col("others")), lambda o: meet("main", F.col("part"), o, F.lit(0)))
    rest = F.concat(
        F.transform(to(F.col("parts")), lambda p: meet("main", p, F.col("part"), F.lit(1))),
        F.transform(to(F.col("others")), lambda o: meet("rest", F.least(o, "part"), F.greatest(o, "part"), F.col("part") > o)),
    )
    cut = placed.select("value", "uid", "component", F.inline(F.when(F.col("main"), own).otherwise(rest)))
    dealt = short.unionByName(cut).groupBy("bucket", "uid", "component").agg(F.collect_list(F.struct("value", "side")).alias("lists"))
    return dealt.join(sets.select("uid", "hashes"), "uid")


def _merged(component: DataFrame, found: DataFrame) -> DataFrame:
    """(uid, component) of the links found, on top of the components before."""
    stars = component.filter("uid != component").select(F.col("uid").alias("a"), F.col("component").alias("b"))
    return connected_components(stars.union(found)).select(F.col("id").alias("uid"), "component")


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row: the least doc_id reachable by links of Jaccard >= percent / 100."""
    docs = docs.select("doc_id", "text")
    sets = _keys(shingle_sets(docs, n))
    quarter = F.filter("hashes", lambda h: h < F.lit(-(1 << 62)))  # of all 64-bit values
    sets = sets.withColumn("quarter", quarter)
    row = F.monotonically_increasing_id().alias("row")
    members = materialise(sets.select(row, "doc_id", "n", "key_a", "key_b", F.size("quarter").alias("held"), "quarter"), "sj_members")
    key = ["n", "key_a", "key_b"]
    some = members.filter("n > 0 and doc_id is not null")
    rows = some.groupBy(*key, "doc_id").agg(F.min("row").alias("uid"), F.count(F.lit(1)).alias("copies"))
    # a class is known by the first row of its least document
    classes = rows.groupBy(*key).agg(F.min(F.struct("doc_id", "uid", "copies")).alias("first")).select(*key, "first.*")
    classes = materialise(classes, "sj_classes")
    component = link_classes(joinable_sets(docs, classes, members, n, percent), percent)
    # rows of one doc_id hang together as well
    several = some.select("doc_id", *key).distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    ids = classes.select(*key, "uid")
    of = some.join(several, "doc_id", "left_semi").join(ids, key).select("doc_id", "uid").distinct()
    first = of.groupBy("doc_id").agg(F.min("uid").alias("b"))
    same = materialise(of.join(first, "doc_id").filter("uid != b").select(F.col("uid").alias("a"), "b"), "sj_same")
    component = materialise(_merged(component, same), "sj_component")
    placed = classes.join(component, "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    least = placed.groupBy("component").agg(F.min("doc_id").alias("least"))
    named = materialise(placed.join(least, "component").select(*key, "least"), "sj_named")
    return members.join(named, key, "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"),
    )
