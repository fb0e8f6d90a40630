"""The four-word join shuffles (shingle, class) rows, and sets only where rows repeat."""

from basketry.llm import signature_join


def test_sets_are_not_shuffled_to_pick_a_class_member(spark, monkeypatch):
    plans, materialise = {}, signature_join.materialise

    def seen(df, name):
        plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString())
        return materialise(df, name)

    monkeypatch.setattr(signature_join, "materialise", seen)
    a, b = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(4, a), (4, a), (2, a + " end"), (7, b), (7, a), (None, a), (8, b), (9, None), (9, "x"), (1, "y")]
    got = signature_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85)
    found = {(r.doc_id, r.component_id) for r in got.collect()}
    assert found == {(4, 2), (2, 2), (7, 2), (8, 2), (None, None), (9, 9), (1, 1)} and got.count() == len(rows)
    assert "first(quarter" not in plans["sj_first"]
