"""Copies with one changed value, with values that coincide, and verbatim copies of items that templates cannot index."""

from basketry.llm import decontaminate
from tests.llm.test_operators import frame

WORDS = "the farmer counts all of his sheep before he walks slowly over the old bridge and sells them at the small market"


def test_slots_and_verbatim_items(spark):
    long = f"In spring {WORDS} where 3 men buy 12 of the sheep and 40 others look on while 12 dogs and 5 cats play with 7 kids"
    same = "Our cook buys 3 sacks of flour and 5 pots of honey and then bakes bread for all the people of the town"
    title = "The Great Silver Lake Near Mount Karo And The Lost Golden Ring"
    dense = "10 20 30 40 50 60 70 80 90 11 22 33"
    bench = spark.createDataFrame(list(enumerate([long, same, title, dense, "who wrote this old song", "who"])), "item_id long, text string")
    texts = [
        f"so. {long.replace('12 dogs', '13 dogs')}", same.replace("3", "4").replace("5", "4"), f"We read {title} today", f"see {dense} ok",
        "Tell me: who wrote this old song?", "who wrote this new song", "10 20 30 40 51 60 70 80 91 11 22 33",
        f"{WORDS.replace('sheep', 'cows').replace('bridge', 'road').replace('sells', 'gives')}",
    ]
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(frame(spark, texts), bench).collect())
    assert got == [(i, i) for i in range(5)]
    assert sorted(r.doc_id for r in decontaminate.decontaminate(frame(spark, texts), bench).collect()) == [5, 6, 7]
