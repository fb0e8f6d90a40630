"""Spelling variants of a vocabulary by blocked Gram matrices of letter counts.

1. Two words are near if one inserted, deleted or replaced letter makes one of the other.  Then the squared distance of
   their letter counts is at most two, and their lengths differ by one at most.
2. Blocks: pairs whose shorter word has ``length`` letters keep the first or the last ``(length - 1) // 2`` letters whole, as
   one edit cannot touch both ends.  A word enters the blocks of its own length and of the length below, by its start and
   by its end; affixes are hashed to buckets of some ``BUCKET`` words, and buckets that hold more than ``TILE`` words are
   cut into tiles, met pair by pair.  So no task holds more than two tiles, whatever affix a third of all words share.
3. In a block one NumPy product of the letter-count matrix with its transpose gives all squared distances; pairs at most
   two apart are verified letter by letter.  A pair that both ends bring together counts at its start only.
4. A word's form is its near word of the largest ``n`` (ties: the smallest word), if that is ``ratio`` times its own; forms
   are followed by doubling, and as ``n`` grows by ``ratio`` at each step, chains are short.

Null and empty words and null counts take no part; repeated words add up; an empty table gives an empty result; other
columns take no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import ascii_lower, broadcast_if_small, materialise

BUCKET, TILE = 512, 1024
#: Maximal runs of Latin letters; those below the least length are never needed.
LETTERS = r"[A-Za-zÀ-ÿ]"


def runs(text: Column, least: int) -> Column:
    """Maximal runs of at least ``least`` letters, A-Z lower-cased; null text has none."""
    return ascii_lower_all(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"{LETTERS}{{{least},}}"), F.lit(0)))


def ascii_lower_all(words: Column) -> Column:
    return F.transform(words, ascii_lower)


def vocabulary(words: DataFrame, least: int, min_count: int) -> DataFrame:
    """(word, n): the words of at least ``least`` letters that occur ``min_count`` times or more."""
    kept = words.filter(F.length("word") >= least)
    return kept.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def _codes(words: list[str], width: int) -> np.ndarray:
    """Code points, a row a word, padded with zeros."""
    return np.array(words, dtype=f"<U{width}").view("<u4").reshape(len(words), width)


def _letter_counts(codes: np.ndarray) -> np.ndarray:
    letters, at = np.unique(codes, return_inverse=True)
    counts = np.zeros((len(codes), len(letters)), np.float32)
    np.add.at(counts, (np.arange(len(codes))[:, None], at.reshape(codes.shape)), 1)
    return counts[:, 1:] if len(letters) and letters[0] == 0 else counts


def _run_length(equal: np.ndarray) -> np.ndarray:
    """Number of leading True values of each row."""
    return np.logical_and.accumulate(equal, 1).sum(1)


def _one_edit(x: np.ndarray, y: np.ndarray, length: int, longer: np.ndarray) -> np.ndarray:
    """Whether one edit turns row by row ``x`` (``length`` letters) into ``y`` (one more where ``longer``)."""
    x = x[:, :length]
    replaced = (x != y[:, :length]).sum(1) == 1
    start, end = _run_length(x == y[:, :length]), _run_length((x == y[:, 1 : length + 1])[:, ::-1])
    return np.where(longer, start + end >= length, replaced)


def near_in_block(block: pd.DataFrame) -> pd.DataFrame:
    """The near pairs of one block, or of two tiles of it: word, other and their counts, both ways."""
    length, side, lo, hi = (block[c].iat[0] for c in ("length", "side", "lo", "hi"))
    words, n, tile = block["word"].to_numpy(), block["n"].to_numpy(), block["tile"].to_numpy()
    codes = _codes(list(words), length + 1)
    longer = codes[:, length] != 0
    counts = _letter_counts(codes)
    square = (counts * counts).sum(1)
    # rows: shorter words; columns: all words; equally long pairs once
    rows, columns = np.flatnonzero(~longer), np.arange(len(words))
    found = [np.empty((2, 0), np.int64)]
    for part in np.array_split(rows, max(1, -(-len(rows) // TILE))):
        distance = square[part, None] + square[None, :] - 2 * (counts[part] @ counts.T)
        wanted = (distance <= 2) & (longer[None, :] | (part[:, None] < columns[None, :]))
        if lo != hi:
            wanted &= tile[part, None] != tile[None, :]
        i, j = np.nonzero(wanted)
        found.append(np.stack([part[i], j]))
    i, j = np.concatenate(found, 1)
    fixed = (length - 1) // 2
    same_start = (codes[i, :fixed] == codes[j, :fixed]).all(1)
    near = _one_edit(codes[i], codes[j], length, longer[j]) & (same_start == (side == "start"))
    i, j = i[near], j[near]
    a, b = np.concatenate([i, j]), np.concatenate([j, i])
    return pd.DataFrame({"word": words[a], "n": n[a], "other": words[b], "other_n": n[b]})


def near_words(vocab: DataFrame) -> DataFrame:
    """(word, n, other, other_n) for every ordered pair of near words of ``vocab`` (word, n; distinct words)."""
    length = F.length("word")
    own = vocab.select("word", "n", F.explode(F.array(length, length - 1)).alias("length")).filter("length > 0")
    fixed = F.floor((F.col("length") - 1) / 2).cast("int")
    ends = F.array(
        F.struct(F.lit("start").alias("side"), F.substring("word", F.lit(1), fixed).alias("affix")),
        F.struct(F.lit("end").alias("side"), F.when(fixed > 0, F.right("word", fixed)).otherwise("").alias("affix")),
    )
    entries = own.select("word", "n", "length", F.inline(ends))
    buckets = entries.groupBy("length").agg(F.ceil(F.count(F.lit(1)) / F.lit(2 * BUCKET)).alias("buckets"))
    entries = entries.join(F.broadcast(buckets), "length").select(  # one row a word length
        "word", "n", "length", "side", F.pmod(F.xxhash64("side", "affix"), F.col("buckets")).alias("bucket")
    )
    entries = materialise(entries, "spelling_entries")
    key = ["length", "side", "bucket"]
    size = entries.groupBy(key).agg(F.count(F.lit(1)).alias("size"))
    hot = size.filter(F.col("size") > TILE).select(*key, F.ceil(F.col("size") / TILE).alias("tiles"))
    tiled = (
        entries.join(broadcast_if_small(materialise(hot, "spelling_hot")), key, "left")
        .withColumn("tiles", F.coalesce("tiles", F.lit(1)))
        .withColumn("tile", F.pmod(F.xxhash64("word", F.lit(3)), F.col("tiles")).cast("int"))
    )
    meets = tiled.withColumn("with", F.explode(F.sequence(F.lit(0), (F.col("tiles") - 1).cast("int"))))
    pairs = meets.select(
        "word", "n", "tile", *key, F.least("tile", "with").alias("lo"), F.greatest("tile", "with").alias("hi")
    )
    return pairs.groupBy(*key, "lo", "hi").applyInPandas(near_in_block, "word string, n long, other string, other_n long")


def follow_forms(forms: DataFrame) -> DataFrame:
    """(word, root) for ``forms`` (word, form): the last of the chain of forms, by doubling."""
    chain = materialise(forms.select("word", F.col("form").alias("root")), "spelling_chain")
    while True:
        step = chain.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ahead = materialise(chain.join(step, "root", "left"), "spelling_ahead")
        if ahead.filter("next is not null").limit(1).count() == 0:
            return chain
        chain = materialise(ahead.select("word", F.coalesce("next", "root").alias("root")), "spelling_chain")


def group_variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of ``words`` (word, n)."""
    vocab = words.filter("word is not null and word != '' and n is not null").groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    vocab = materialise(vocab, "spelling_words")
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("word")))
    near = near_words(vocab).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    large = -F.col("best.minus") >= F.lit(ratio) * F.col("n")
    judged = vocab.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(large, F.col("best.word")).alias("form"), F.when(large, -F.col("best.minus")).alias("form_n"),
    )
    judged = materialise(judged, "spelling_judged")
    roots = follow_forms(judged.filter("form is not null"))
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
