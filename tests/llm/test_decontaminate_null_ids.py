"""Documents without doc_id are found and dropped by their text."""

from basketry.llm import decontaminate
from tests.llm.test_operators import frame

ITEM = "the farmer counts all of his sheep before he walks slowly over the old bridge and sells them at the small market"


def test_null_ids(spark):
    bench = spark.createDataFrame([(1, ITEM), (2, "who wrote this old song"), (None, "10 20 30 40 50 60 70 80 90 11 22 33")], "item_id long, text string")
    rows = [
        (None, f"so. {ITEM}", "a"), (None, f"so. {ITEM}", "b"), (None, "a clean text of nobody", "a"), (None, None, "a"), (None, "", "a"),
        (5, f"And {ITEM}", "a"), (5, "clean part of document five", "a"), (6, "clean", "a"), (None, "say: who wrote this old song?", "a"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    left = sorted(str(tuple(r)) for r in decontaminate.decontaminate(docs, bench).collect())
    assert left == sorted(str(rows[i]) for i in (2, 3, 4, 7))
    found = [(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()]
    assert sorted(found, key=str) == [(5, 1), (None, 1), (None, 2)]
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == len(rows)
    assert decontaminate.decontaminate(frame(spark, []), bench).count() == 0
