"""Spans beyond the base patterns are found by the trees, and clean numbers are left alone."""

import random

from basketry.llm import pii
from tests.llm.test_operators import frame


def _card(rng):
    digits = [rng.randint(0, 9) for _ in range(15)]
    total = sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits))
    return "".join(map(str, digits)) + str(-total % 10)


def test_trees_add_spans(spark):
    rng = random.Random(2)
    texts, want = [], {}
    for i in range(900):
        card, other = _card(rng), "".join(str(rng.randint(0, 9)) for _ in range(16))
        while pii_luhn(other):
            other = "".join(str(rng.randint(0, 9)) for _ in range(16))
        kind = i % 6
        if kind == 0:
            texts.append(f"card {card} paid")
        elif kind == 1:
            texts.append(f"order {other} sent")
        elif kind == 2:
            texts.append(f"write to ann{i}@mail.example now")
        elif kind == 3:  # two cards with a blank between fail the base check as one run
            second = _card(rng)
            texts.append(f"cards {card} {second} done")
            want[i] = {f"card:6:22", f"card:23:39"}
        elif kind == 4:
            texts.append(f"mail bob{i} (at) site.example today")
            want[i] = {f"email:5:{5 + len(f'bob{i} (at) site.example')}"}
        else:
            texts.append(f"the year {1900 + i % 100} had {i} days and {rng.randint(1000, 9999)} hours")
    got = {r.doc_id: r for r in pii.personal_data(frame(spark, texts)).collect()}
    found = {i: set(got[i].spans.split(",")) - {""} for i in got}
    caught = sum(want[i] <= found[i] for i in want)
    assert caught >= 0.95 * len(want)
    clean = [i for i in got if i % 6 in (1, 5)]
    assert sum(got[i].n_added for i in clean) <= 0.02 * len(clean)
    assert all(got[i].n_added == 0 and found[i] for i in got if i % 6 in (0, 2))


def pii_luhn(digits):
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0
