"""KPIs read the partials unmerged and fold them without sets; receipts of the incremental query are built once."""

import pytest
from pyspark.sql import functions as F

from basketry.operators import customers
from basketry.plans import catalog, partials
from basketry.schemas import ENRICHED_SCHEMA
from basketry.sources.snapshots import load
from tests.conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_partials_reach_the_folds_unmerged(spark, tmp_path, monkeypatch):
    table, parts = str(tmp_path / "t"), str(tmp_path / "p")
    load(spark, table, catalog.enriched_from_tables(spark, SF_SMALL))
    partials.refresh_partials(spark, table, parts)
    seen = []
    monkeypatch.setattr(partials, "run_kpis", lambda enriched, *_, **__: seen.append(enriched))
    partials.run_kpis_from_partials(spark, parts, str(tmp_path / "m"))
    assert "Aggregate" not in _plan(seen[0])


def test_features_without_sets(spark):
    """Null customers and products, products of several categories and of none."""
    rows = [(None, 1, c, p, n, k, None) for c, p, n, k in [
        (1, 1, 2, 10), (1, 1, 1, 11), (1, 2, 1, 10), (1, 3, 1, None), (1, None, 4, None),
        (None, 1, 1, 10), (None, 2, 1, 12), (2, 5, 1, None), (3, 6, None, None),
    ]]
    fact = spark.createDataFrame(rows, ENRICHED_SCHEMA)
    visits = spark.createDataFrame([(1,), (1,), (2,)], "cliente_id int")
    got = customers.customer_features(fact, visits)
    assert "collect_set" not in _plan(got)
    assert {tuple(r) for r in got.collect()} == {(1, 2, 9, 3, 2), (None, 0, 2, 2, 2), (2, 1, 1, 1, 0), (3, 0, None, 1, 0)}
    assert {tuple(r) for r in customers.customer_units(got.select("cliente_id", F.col("total_cantidad").alias("cantidad"))).collect()} == {
        tuple(r) for r in customers.customer_units(fact).collect()
    }


def test_incremental_receipts_are_built_once(spark, monkeypatch):
    class Stop(Exception):
        pass

    def stop(df, path):
        assert "Join" not in _plan(df)
        raise Stop

    monkeypatch.setattr(catalog.csv_io, "write_baskets", stop)
    with pytest.raises(Stop):
        catalog.q_etl_partials_incremental(spark, SF_SMALL)
