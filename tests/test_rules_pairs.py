"""Product rules count pairs alone: long and equal baskets give their pairs, not their itemsets."""

import itertools
import random
from collections import Counter

import pytest

from basketry.operators import recommend


@pytest.mark.parametrize("block", [1, 3, 128])
def test_pairs_of_long_baskets(spark, monkeypatch, block):
    monkeypatch.setattr(recommend, "BLOCK", block)
    rng = random.Random(block)
    baskets = [rng.sample(range(40), n) for n in (0, 1, 2, 3, 4, 7, 12, 30)]
    rows = [(b + [None],) for b in baskets] + [([5, 5, 9],)]
    got = Counter(tuple(r) for r in recommend.product_pairs(spark.createDataFrame(rows, "productos array<int>")).collect())
    assert got == Counter(p for b in [*baskets, [5, 9]] for p in itertools.combinations(sorted(b), 2))


def test_equal_baskets_give_pairs_not_itemsets(spark):
    rules = recommend.product_rules(spark.createDataFrame([(list(range(60)),)] * 2, "productos array<int>")).collect()
    assert len(rules) == 60 * 59 and {(r.n_visitas, r.soporte, r.confianza, r.lift) for r in rules} == {(2, 1.0, 1.0, 1.0)}
