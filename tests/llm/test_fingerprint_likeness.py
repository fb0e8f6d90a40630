"""Likeness, containment and distinct counts of fingerprints against the sets themselves; row numbers in any number of buckets."""

import random

import pytest
from pyspark.sql import functions as F

from basketry.llm import common, fingerprints
from tests.llm.test_operators import frame, tokens


def shingles(text, n=5):
    w = tokens(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def test_figures_against_whole_sets(spark):
    draw = random.Random(7)
    texts = [" ".join(draw.choice("abcdef") * draw.randint(1, 2) for _ in range(draw.randint(0, 40))) for _ in range(40)]
    long = [f"w{draw.randint(0, 999)}" for _ in range(2000)]
    for i in range(20):
        texts.append(" ".join(w if draw.random() > 0.01 * i else f"new{i}" for w in long))
    texts += [None, "", " \t", "one", texts[0], texts[45]]
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(frame(spark, texts)).collect()}
    misses = []
    for i, text in enumerate(texts):
        text, after = text or "", texts[i - 1] or ""
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        own, other, nxt = shingles(text), shingles(edited), shingles(after)
        for seen, b in ((got[i].near_edited, other), (got[i].near_next, nxt)):
            want = len(own & b) / len(own | b) if own | b else 1.0
            if len(own | b) <= fingerprints.K:
                assert seen == pytest.approx(want)
            misses.append(abs(seen - want))
        if len(own | other) < fingerprints.K:
            assert got[i].n_shingles == len(own)
            assert got[i].edited_contains == pytest.approx(len(own & other) / len(own) if own else 1.0)
        else:
            assert 0.5 < got[i].n_shingles / len(own) < 1.7
            assert abs(got[i].edited_contains - len(own & other) / len(own)) < 0.35
    # 64 values: a standard deviation of 0.0625 at most
    assert max(misses) < 0.3 and sum(misses) / len(misses) < 0.04


@pytest.mark.parametrize("least, broadcast", [(1, 500_000), (4096, 500_000), (7, 0)])
def test_row_numbers_in_any_number_of_buckets(spark, monkeypatch, least, broadcast):
    monkeypatch.setattr(common, "LEAST_BUCKETS", least)
    monkeypatch.setattr(common, "BUCKET_ROWS", 50)
    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast)
    df = spark.range(1000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("id"), F.lit("clash").alias("bucket"))
    got = common.row_numbers(df, ["id"], "at", 1000).collect()
    assert sorted(r["at"] for r in got) == list(range(1000)) and got[0].bucket == "clash"
    assert common.row_numbers(df.limit(0), ["id"], "at", 0).count() == 0
