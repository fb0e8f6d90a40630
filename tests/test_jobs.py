"""Newest record per key and last N records (W2, T9) against pandas."""

from basketry.operators.jobs import latest_per_key, recent_n
from basketry.sources.tables import read_table
from tests.conftest import SF_SMALL


def test_latest_per_key(spark):
    ev = read_table(spark, SF_SMALL, "events")
    got = {r.event_type: r.event_id for r in latest_per_key(ev, "event_type", "event_id").collect()}
    pdf = ev.toPandas()
    assert got == pdf.groupby("event_type").event_id.max().to_dict()
    assert latest_per_key(ev, "event_type", "event_id").columns == ev.select("event_type", *[c for c in ev.columns if c != "event_type"]).columns


def test_latest_per_key_keeps_nulls_and_ties(spark):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), (None, 5, "n"), (None, None, "m"), ("b", None, "o"), ("b", None, "p"), ("c", None, "q"), ("c", 3, "r")]
    got = latest_per_key(spark.createDataFrame(rows, "k string, at int, v string"), "k", "at").collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(
        str(t) for t in [("a", 2, "y"), ("a", 2, "z"), (None, 5, "n"), ("b", None, "o"), ("b", None, "p"), ("c", 3, "r")]
    )


def test_recent_n(spark):
    ev = read_table(spark, SF_SMALL, "events")
    got = [r.event_id for r in recent_n(ev, "event_id", 20).collect()]
    assert got == sorted(ev.toPandas().event_id, reverse=True)[:20]
