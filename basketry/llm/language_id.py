"""Language identification by rank-order profiles.

Every language's profile is its ``PROFILE`` most frequent character n-grams (1 to 3 characters over letters and word
bounds), counted over all learning texts.  A document's own most frequent n-grams are ranked alike, and the language with
the least out-of-place distance wins: the sum of rank differences, with the full ``PROFILE`` for an n-gram that the
language lacks.  Ties of counts fall to the lesser code, ties of distance to the lesser language.

Counting and ranking run in Arrow batches inside tasks; counts are merged by a shuffle on (language, n-gram).  Profiles
are compared in blocks of ``BLOCK`` languages (some 6 MB each), so what is sent to the tasks is bounded for any number
of label values.

Null texts and texts without a letter are ``und`` with score 0, as is everything if nothing can be learned.  Null ids are
not held out; repeated rows are each predicted; an empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import materialise

PROFILE, BLOCK = 400, 1024
_OTHER = re.compile(r"[\W\d_]+")
#: Characters of a text that are counted at once.
CHUNK = 1 << 20


def gram_codes(text: str) -> np.ndarray:
    """Codes of all 1-, 2- and 3-grams: 21 bits a character, no gram of bounds alone."""
    clean = _OTHER.sub(" ", text.lower()).strip()
    if not clean:
        return np.empty(0, np.int64)
    c = np.frombuffer(f" {clean} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    two = c[:-1] | (c[1:] << 21)
    return np.concatenate([c[c != 32], two, two[:-1] | (c[2:] << 42)])


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram codes of a text and their counts; long texts are counted chunk by chunk."""
    if len(text) <= CHUNK:
        return np.unique(gram_codes(text), return_counts=True)
    parts = [counted(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)]
    codes, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return codes, np.bincount(where, np.concatenate([p[1] for p in parts])).astype(np.int64)


def _count_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of n-grams, given out whenever ``CHUNK`` codes are held: a batch of long texts is never held at once."""
    for batch in batches:
        for lang, texts in batch.groupby("lang")["text"]:
            held, size = [], 0
            for text in texts:
                for i in range(0, len(text), CHUNK):
                    held.append(gram_codes(text[i : i + CHUNK]))
                    size += len(held[-1])
                    if size >= CHUNK:
                        yield _counts(lang, held)
                        held, size = [], 0
            if size:
                yield _counts(lang, held)


def _counts(lang: str, codes: list[np.ndarray]) -> pd.DataFrame:
    code, n = np.unique(np.concatenate(codes), return_counts=True)
    return pd.DataFrame({"lang": lang, "code": code, "n": n})


def learn_profiles(texts: DataFrame) -> DataFrame:
    """(lang, code, place): the ``PROFILE`` most frequent n-grams of each language of ``texts`` (lang, text)."""
    counts = (
        texts.select("lang", "text")
        .filter("lang is not null and text is not null and text != ''")
        .mapInPandas(_count_batches, "lang string, code long, n long")
        .groupBy("lang", "code")
        .agg(F.sum("n").alias("n"))
    )
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code")) - 1
    return counts.withColumn("place", place).filter(F.col("place") < PROFILE).select("lang", "code", "place")


def _ranked(text: str) -> np.ndarray:
    codes, n = counted(text)
    return codes[np.lexsort((codes, -n))[:PROFILE]]


def _predictor(rows: list):
    """Function from a text to (language, distance per n-gram and PROFILE) over the given profile rows."""
    langs = sorted({r.lang for r in rows})
    codes = np.array(sorted({r.code for r in rows}), np.int64)
    # a row of places for every code, and a last one for codes that no language has
    places = np.full((len(codes) + 1, len(langs)), -1, np.int32)
    column = {lang: i for i, lang in enumerate(langs)}
    places[np.searchsorted(codes, [r.code for r in rows]), [column[r.lang] for r in rows]] = [r.place for r in rows]

    def predict(text: str) -> tuple[str | None, float]:
        own = _ranked(text)
        if not len(own):
            return None, 1.0
        at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
        there = places[np.where(codes[at] == own, at, len(codes))]
        away = np.where(there < 0, PROFILE, np.abs(there - np.arange(len(own))[:, None])).sum(0)
        i = int(away.argmin())
        return langs[i], float(away[i]) / (len(own) * PROFILE)

    return predict


def identify(docs: DataFrame, profiles: DataFrame) -> DataFrame:
    """``docs`` (with ``text``) with ``lang_pred`` and ``score``: 1 less the share of the greatest possible distance."""
    profiles = materialise(profiles, "lang_profiles")
    langs = Window.orderBy("lang")  # one row a language
    blocks = profiles.select("lang").distinct().withColumn("block", F.floor((F.row_number().over(langs) - 1) / BLOCK))
    blocks = materialise(blocks, "lang_blocks")
    n_blocks = (blocks.agg(F.max("block")).first()[0] or 0) + 1
    best = F.struct(F.lit(2.0).alias("d"), F.lit(None).cast("string").alias("lang"))
    out = docs.withColumn("__best", best)
    for block in range(n_blocks):
        # at most BLOCK * PROFILE rows
        rows = profiles.join(blocks.filter(F.col("block") == block), "lang").select("lang", "code", "place").collect()
        if not rows:
            continue
        predict = _predictor(rows)

        @F.pandas_udf("struct<d: double, lang: string>")
        def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for texts in batches:
                found = [predict(t) if t else (None, 1.0) for t in texts]  # noqa: B023
                yield pd.DataFrame({"d": [d for _, d in found], "lang": [lang for lang, _ in found]})

        out = out.withColumn("__new", nearest("text")).withColumn(
            "__best", F.when(F.col("__new.lang").isNotNull() & (F.col("__new.d") < F.col("__best.d")), F.col("__new")).otherwise(F.col("__best"))
        )
        out = out.drop("__new")
    known = F.col("__best.lang").isNotNull()
    return out.withColumns(
        {
            "lang_pred": F.when(known, F.col("__best.lang")).otherwise(F.lit("und")),
            "score": F.when(known, F.greatest(F.lit(0.0), 1 - F.col("__best.d"))).otherwise(F.lit(0.0)),
        }
    ).drop("__best")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def predict_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, learned from those that are not held out."""
    learn = docs.filter(~held_out(F.col("doc_id"))).select("lang", "text")
    texts = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return identify(texts, learn_profiles(learn)).select("doc_id", "held_out", "lang_pred", "score")
