"""Hard negatives by segment summaries: bounds on inner products prune pairs before exact scoring.

1. Vectors are held as integers; each is cut into segments at ``LEVELS`` grains, and every segment's mean and deviation are
   stored beside it.  For two vectors a segment of ``w`` components adds ``w * (mean * mean' +- deviation * deviation')`` to
   the bounds of their score (Cauchy-Schwarz on what is left of the means).
2. Anchors meet all rows in blocks: a block of anchors (``BLOCK`` components) is sent to the tasks, and every task reads its
   rows once.  Pairs whose bounds at the coarsest grain cannot reach what the anchor still looks for are dropped, the
   others are bounded by finer segments, and only what is left is scored exactly.
3. A task keeps the best ``k`` rows of every wanted window; a first pass over a sixteenth of the rows gives floors which a
   row must reach, so that tasks hand over few rows, and one shuffle keeps the best of all tasks.  Every row is seen.
4. Positives are the best rows of the anchor's label.  Around each positive's score lies a window; the best rows of other
   labels within it are its negatives.

Rows with a null label, a null vector or any component that is null or not finite take no part.  Only vectors of the same
length are compared; empty vectors score 0.  Null ids are never anchors and come last among ties; rows that share an id are
rows of their own.  Components are held within +-2^24, so that scores fit a long.  An empty table gives an empty result;
other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import materialise
from basketry.session import scratch_path

LEVELS, SPLIT, BLOCK = 3, 4, 1 << 20
#: Pairs that a task bounds at once, and the share of them below which the rest is gathered pair by pair.
PAIRS, SPARSE = 1 << 21, 0.05
LIMIT = 1 << 24
_FOUND = "uid long, target int, score long, vec_id long, row long"


def grains(dim: int) -> list[int]:
    """Segment lengths, from the whole vector down."""
    return [max(1, -(-dim // SPLIT**level)) for level in range(LEVELS)] if dim else []


def summaries(q: np.ndarray) -> np.ndarray:
    """Mean and deviation of every segment of every row, grain by grain."""
    parts = []
    for width in grains(q.shape[1]):
        starts = np.arange(0, q.shape[1], width)
        size = np.diff(np.append(starts, q.shape[1]))
        mean = np.add.reduceat(q, starts, 1) / size
        away = q - np.repeat(mean, size, 1)
        parts += [mean, np.sqrt(np.add.reduceat(away * away, starts, 1) / size)]
    return np.concatenate(parts, 1) if parts else np.empty((len(q), 0))


def _by_dim(table: pa.Table, column: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The rows of each vector length with their vectors as a matrix."""
    lengths = table.column("dim").to_numpy()
    for dim in np.unique(lengths):
        part = table.filter(pa.array(lengths == dim))
        flat = part.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        yield part, flat.reshape(part.num_rows, -1).astype(np.float64)


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, q in _by_dim(pa.Table.from_batches([batch]), "q"):
            s = summaries(q)
            offsets = pa.array(np.arange(len(s) + 1, dtype=np.int32) * s.shape[1])
            column = pa.ListArray.from_arrays(offsets, pa.array(s.reshape(-1)))
            yield from part.append_column("summary", column).combine_chunks().to_batches()


def summary_table(vectors: DataFrame, vec_id: str, vector: str, label: str, scale: int = 256) -> DataFrame:
    """(uid, vec_id, label, dim, q, summary) of the rows that take part, written once."""
    x = F.col(vector)
    good = F.col(label).isNotNull() & x.isNotNull() & ~F.exists(
        x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == F.lit(float("inf")))
    )
    whole = lambda c: F.greatest(F.least(F.floor(F.lit(scale) * c.cast("double")), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int")
    rows = vectors.filter(good).select(
        F.monotonically_increasing_id().alias("uid"), F.col(vec_id).cast("long").alias("vec_id"),
        F.col(label).cast("long").alias("label"), F.size(x).alias("dim"), F.transform(x, whole).alias("q"),
    )
    schema = "uid long, vec_id long, label long, dim int, q array<int>, summary array<double>"
    return materialise(rows.mapInArrow(_summarise, schema), "hn_rows")


class _Side:
    """The vectors of one length: integers, scaled summaries by grain, labels and ids."""

    def __init__(self, part: pa.Table, q: np.ndarray):
        self.q, n = q, part.num_rows
        flat = part.column("summary").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        self.levels, at, s = [], 0, flat.reshape(n, -1)
        for width in grains(q.shape[1]):
            starts = np.arange(0, q.shape[1], width)
            weight = np.sqrt(np.diff(np.append(starts, q.shape[1])))
            k = len(starts)
            self.levels.append((s[:, at : at + k] * weight, s[:, at + k : at + 2 * k] * weight))
            at += 2 * k
        self.norm = np.sqrt((q * q).sum(1))
        self.top = float(np.abs(q).max()) if q.size else 0.0
        self.uid = part.column("uid").to_numpy()
        self.label = part.column("label").to_numpy()
        ids = part.column("vec_id").combine_chunks()
        self.no_id = ids.is_null().to_numpy(zero_copy_only=False)
        self.id = ids.fill_null(0).to_numpy()


class _Anchors(_Side):
    """A side with windows: rows (anchor) by targets (lo, hi, floor), empty where lo > hi."""

    def __init__(self, part: pa.Table, q: np.ndarray):
        super().__init__(part, q)
        flat = lambda c: part.column(c).combine_chunks().flatten().to_numpy().reshape(part.num_rows, -1).astype(np.float64)
        self.lo, self.hi, self.floor = flat("lo"), flat("hi"), flat("floor")


def _exact(a: np.ndarray, b: np.ndarray, safe: bool, paired: bool) -> np.ndarray:
    if not safe:
        a, b = a.astype(np.int64), b.astype(np.int64)
    return np.einsum("ij,ij->i", a, b) if paired else a @ b.T


def _pairs(a: _Anchors, r: _Side, rows: np.ndarray, anchors: np.ndarray, floor: np.ndarray, same: bool):
    """(anchor, row, score) of the pairs that can be of use, by bounds from coarse to fine and an exact score."""
    least = np.maximum(a.lo[anchors], floor[anchors])
    low = np.where(a.lo[anchors] <= a.hi[anchors], least, np.inf).min(1)
    high = np.where(a.lo[anchors] <= a.hi[anchors], a.hi[anchors], -np.inf).max(1)
    alive = (a.label[anchors, None] == r.label[None, rows]) == same
    if same:
        alive &= a.uid[anchors, None] != r.uid[None, rows]
    safe = a.top * r.top * max(1, a.q.shape[1]) < 2**53
    # rounding of the summaries, far above what doubles lose
    slack = 1e-9 * a.norm[anchors][:, None] * r.norm[None, rows] + 1e-6
    i = j = None
    for (ma, da), (mr, dr) in zip(a.levels, r.levels):
        if i is None:
            middle, spread = ma[anchors] @ mr[rows].T, da[anchors] @ dr[rows].T + slack
            alive &= (middle + spread >= low[:, None]) & (middle - spread <= high[:, None])
            use_a, use_r = alive.any(1), alive.any(0)
            anchors, rows, low, high = anchors[use_a], rows[use_r], low[use_a], high[use_a]
            alive, slack = alive[np.ix_(use_a, use_r)], slack[np.ix_(use_a, use_r)]
            if alive.sum() < SPARSE * alive.size:
                i, j = np.nonzero(alive)
        else:
            middle = np.einsum("ij,ij->i", ma[anchors[i]], mr[rows[j]])
            spread = np.einsum("ij,ij->i", da[anchors[i]], dr[rows[j]]) + slack[i, j]
            keep = (middle + spread >= low[i]) & (middle - spread <= high[i])
            i, j = i[keep], j[keep]
    if i is None:
        scores = _exact(a.q[anchors], r.q[rows], safe, False)
        i, j = np.nonzero(alive & (scores >= low[:, None]) & (scores <= high[:, None]))
        return anchors[i], rows[j], scores[i, j]
    scores = _exact(a.q[anchors[i]], r.q[rows[j]], safe, True)
    keep = (scores >= low[i]) & (scores <= high[i])
    return anchors[i[keep]], rows[j[keep]], scores[keep]


class _Best:
    """The best ``k`` rows of every target (anchor * windows + window), ties by id, null ids last."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor.copy()
        self.rows = np.empty((5, 0), np.int64)  # target, score, no_id, id, uid

    def add(self, target, score, no_id, ids, uid) -> None:
        new = np.stack([c.astype(np.int64) for c in (target, score, no_id, ids, uid)])
        rows = np.concatenate([self.rows, new], 1)
        rows = rows[:, np.lexsort((rows[4], rows[3], rows[2], -rows[1], rows[0]))]
        first = np.append(True, rows[0, 1:] != rows[0, :-1]) if rows.shape[1] else np.empty(0, bool)
        place = np.arange(rows.shape[1]) - np.maximum.accumulate(np.where(first, np.arange(rows.shape[1]), 0))
        self.rows = rows[:, place < self.k]
        last = self.rows[:, place[place < self.k] == self.k - 1]
        flat = self.floor.reshape(-1)
        flat[last[0]] = np.maximum(flat[last[0]], last[1])


def _scan(a: _Anchors, r: _Side, best: _Best, same: bool) -> None:
    """Let the rows of one batch meet the anchors of the block."""
    windows = a.lo.shape[1]
    by_label = [(np.flatnonzero(a.label == x), np.flatnonzero(r.label == x)) for x in np.intersect1d(a.label, r.label)]
    for anchors, rows in by_label if same else [(np.arange(len(a.q)), np.arange(len(r.q)))]:
        step, at = max(1, min(256, PAIRS // max(1, len(anchors)))), 0
        while at < len(rows):
            i, j, score = _pairs(a, r, rows[at : at + step], anchors, best.floor, same)
            at, step = at + step, max(1, min(4 * step, PAIRS // max(1, len(anchors))))
            for w in range(windows):
                use = (score >= np.maximum(a.lo[i, w], best.floor[i, w])) & (score <= a.hi[i, w])
                if use.any():
                    t, x = i[use], j[use]
                    best.add(t * windows + w, score[use], r.no_id[x], r.id[x], r.uid[x])


def best_in_windows(rows: DataFrame, anchors: DataFrame, k: int, same: bool) -> DataFrame:
    """(uid, target, place, score, vec_id, row): for each anchor and window the first ``k`` rows, place from 1.

    ``anchors`` has the columns of :func:`summary_table` and ``lo``, ``hi``, ``floor`` (array<long>, one entry a window).
    """
    spark = rows.sparkSession
    total = anchors.agg(F.sum(F.col("dim") + 1)).first()[0] or 0
    blocks = -(-total // BLOCK)
    path = scratch_path(spark, "hn_found")
    spark.createDataFrame([], _FOUND).write.parquet(path)
    for block in range(blocks):
        # some BLOCK components of vectors with their summaries and windows: 16 MB
        mine = anchors.filter(F.pmod(F.xxhash64("uid"), F.lit(blocks)) == block).toArrow()

        def search(batches: Iterator[pa.RecordBatch], mine=mine) -> Iterator[pa.RecordBatch]:
            sides = {q.shape[1]: _Anchors(part, q) for part, q in _by_dim(mine, "q")}
            best = {dim: _Best(len(a.q), k, a.floor) for dim, a in sides.items()}
            for batch in batches:
                for part, q in _by_dim(pa.Table.from_batches([batch]), "q"):
                    if q.shape[1] in sides:
                        _scan(sides[q.shape[1]], _Side(part, q), best[q.shape[1]], same)
            for dim, a in sides.items():
                target, score, no_id, ids, uid = best[dim].rows
                windows = a.lo.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a.uid[target // windows]), pa.array((target % windows).astype(np.int32)), pa.array(score),
                     pa.array(ids, mask=no_id.astype(bool)), pa.array(uid)],
                    names=["uid", "target", "score", "vec_id", "row"],
                )

        rows.mapInArrow(search, _FOUND).write.mode("append").parquet(path)
    found = spark.read.schema(_FOUND).parquet(path)
    order = Window.partitionBy("uid", "target").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def _with_floors(rows: DataFrame, anchors: DataFrame, k: int, same: bool) -> DataFrame:
    """``anchors`` whose floors are the k-th scores within a sixteenth of the rows: the whole table's are no less."""
    some = rows.filter(F.pmod(F.xxhash64("uid", F.lit(16)), F.lit(16)) == 0)
    kth = best_in_windows(some, anchors, k, same).filter(F.col("place") == k)
    floors = kth.groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("target", "score"))).alias("kth"))
    raised = F.transform("lo", lambda lo, i: F.coalesce(F.col("kth")[i], lo))
    return materialise(anchors.join(floors, "uid", "left").withColumn("floor", raised).drop("kth"), "hn_anchors")


def mine_hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For every row that satisfies ``anchor`` (over ``vec_id``) and each of its first ``positives`` rows of the same label, the
    first ``negatives`` rows of other labels with ``low`` to ``high`` percent of the positive's score.
    """
    rows = summary_table(vectors, vec_id, vector, label)
    anchors = rows.filter(F.coalesce(anchor, F.lit(False)))
    # scores lie within +- 2^62
    far = 1 << 62
    one = lambda x: F.array(F.lit(x).cast("long"))
    open_window = anchors.withColumns({"lo": one(-far), "hi": one(far), "floor": one(-far)})
    near = best_in_windows(rows, _with_floors(rows, open_window, positives, True), positives, True)
    near = materialise(near.select("uid", "place", "score", "vec_id"), "hn_positives")
    windows = near.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("place", "score"))).alias("near"))
    lo = lambda p: F.ceil(p["score"].cast("decimal(20,0)") * low / 100).cast("long")
    hi = lambda p: F.floor(p["score"].cast("decimal(20,0)") * high / 100).cast("long")
    # anchors with fewer positives get empty windows in their place
    filled = lambda c, x: F.transform(
        F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(F.get(c, i), F.lit(x).cast("long"))
    )
    bounded = anchors.join(windows, "uid").withColumns(
        {"lo": filled(F.transform("near", lo), 1), "hi": filled(F.transform("near", hi), 0)}
    )
    bounded = materialise(bounded.withColumn("floor", F.col("lo")).drop("near"), "hn_windows")
    found = best_in_windows(rows, _with_floors(rows, bounded, negatives, False), negatives, False)
    negative = found.select(
        "uid", (F.col("target") + 1).alias("place"), F.col("place").alias("rank"),
        F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"),
    )
    positive = near.select("uid", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    ids = anchors.select("uid", F.col("vec_id").alias("anchor_id"))
    return (
        negative.join(positive, ["uid", "place"])
        .join(ids, "uid")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
