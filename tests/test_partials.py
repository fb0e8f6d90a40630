"""KPI marts from the partials equal the marts from the fact; an incremental refresh is exact."""

import os

import pytest
from pyspark.sql import functions as F

from basketry.operators.kpis import unique_counts
from basketry.plans.catalog import enriched_from_tables
from basketry.plans.etl_job import run_etl
from basketry.plans.kpi_job import mart_status, refresh_marts, run_kpis
from basketry.plans.partials import read_partials, refresh_partials, run_kpis_from_partials, unique_counts_from_partials
from basketry.sources.parquet import read_enriched, read_mart
from basketry.sources.snapshots import compact, load, snapshot
from tests.conftest import SF_SMALL

MARTS = ["kpis", "top_products", "top_customers", "peak_days", "category_share", "category_pie",
         "daily_series", "customer_box", "customer_outliers", "customer_corr"]


def _rows(df):
    return sorted(str(tuple(r)) for r in df.select(*sorted(df.columns)).collect())


def _same_marts(spark, a, b):
    for m in MARTS:
        assert _rows(read_mart(spark, f"{a}/{m}")) == _rows(read_mart(spark, f"{b}/{m}")), m


def test_partials_give_the_same_marts(spark, tmp_path):
    table = str(tmp_path / "fact")
    load(spark, table, enriched_from_tables(spark, SF_SMALL))
    run_kpis(read_enriched(spark, table), str(tmp_path / "direct"))
    refresh_partials(spark, table, str(tmp_path / "partials"))
    run_kpis_from_partials(spark, str(tmp_path / "partials"), str(tmp_path / "folded"))
    _same_marts(spark, str(tmp_path / "direct"), str(tmp_path / "folded"))


def test_incremental_refresh_matches_full(spark, write_lines, tmp_path):
    """Foreign-branch lines, files without a branch, changed and removed files: only new versions are folded."""
    from tests.test_manifest_etl import _setup

    tx, pc, cat = _setup(write_lines)
    table, parts = str(tmp_path / "t"), str(tmp_path / "p")
    run_etl(spark, tx, pc, cat, table)
    assert refresh_partials(spark, table, parts) == [1]
    assert refresh_partials(spark, table, parts) == []
    # 102 gains lines of 103 and 110, 103 disappears, 105 opens, a file names no branch
    os.remove(os.path.join(tx, "103_Tran.csv"))
    write_lines("tx", "102_Tran.csv", ["2013-01-05|102|9|3 3", "2013-01-05|103|1|1", "2013-01-05|110|1|1 1 1"])
    write_lines("tx", "105_Tran.csv", ["2013-01-06|105|1|2"])
    write_lines("tx", "norte_Tran.csv", ["2013-01-06|115|-4|2 1"])
    r = run_etl(spark, tx, pc, cat, table)
    assert (r.ingested, r.removed, r.touched) == ([-2, 102, 105], [103], [102, 103, 105, 110, 115])
    assert refresh_partials(spark, table, parts) == [v for v in snapshot(spark, table).versions if v > 1]
    units = read_partials(spark, parts)["customer_products"].groupBy("sucursal_id").agg(F.sum("cantidad").alias("n"))
    assert {x.sucursal_id: x.n for x in units.collect()} == {102: 2, 103: 1, 104: 2, 105: 1, 110: 3, 115: 2}

    def same(step):
        run_kpis_from_partials(spark, parts, str(tmp_path / f"inc{step}"))
        run_kpis(read_enriched(spark, table), str(tmp_path / f"full{step}"))
        _same_marts(spark, str(tmp_path / f"inc{step}"), str(tmp_path / f"full{step}"))
        got = unique_counts_from_partials(read_partials(spark, parts)["distincts"])
        assert got.collect() == unique_counts(read_enriched(spark, table)).collect()

    same(1)
    assert compact(spark, table, max_versions=1) is not None
    assert refresh_partials(spark, table, parts) == [snapshot(spark, table).version]
    same(2)


def test_bitmaps_count_exactly(spark, tmp_path):
    """Ids around the bitmaps' bounds, negative ones and extremes, in overlapping branches."""
    ids = [0, 1, -1, 32767, 32768, 32769, -32767, -32768, 2**31 - 1, -(2**31)]
    rows = [(b, i, ids[(k + b) % len(ids)]) for b in (1, 2, 3) for k, i in enumerate(ids) if k != b]
    fact = spark.createDataFrame(rows, "sucursal_id int, cliente_id int, producto_id int").selectExpr(
        "date'2013-01-01' as fecha", "*", "1 as cantidad", "cast(null as int) as categoria_id", "cast(null as string) as nombre_categoria"
    )
    load(spark, str(tmp_path / "t"), fact)
    refresh_partials(spark, str(tmp_path / "t"), str(tmp_path / "p"))
    got = unique_counts_from_partials(read_partials(spark, str(tmp_path / "p"))["distincts"])
    assert got.collect() == unique_counts(fact).collect()
    load(spark, str(tmp_path / "none"), fact.limit(0))
    refresh_partials(spark, str(tmp_path / "none"), str(tmp_path / "np"))
    assert tuple(unique_counts_from_partials(read_partials(spark, str(tmp_path / "np"))["distincts"]).first()) == (0, 0)


def test_chain_marks_stale_marts(spark, write_lines, tmp_path, monkeypatch):
    """Marts follow the table; a failed KPI run leaves marts that say so, and the next run mends them."""
    from basketry.plans import kpi_job
    from tests.test_manifest_etl import _setup

    tx, pc, cat = _setup(write_lines)
    table, marts = str(tmp_path / "t"), str(tmp_path / "m")
    assert mart_status(spark, marts, table).stale
    run_etl(spark, tx, pc, cat, table)
    assert len(refresh_marts(spark, table, marts)) == len(MARTS)
    assert not mart_status(spark, marts, table).stale
    assert refresh_marts(spark, table, marts) == []
    write_lines("tx", "105_Tran.csv", ["2013-01-06|105|1|2"])
    run_etl(spark, tx, pc, cat, table)
    status = mart_status(spark, marts, table)
    assert status.stale and (status.shown, status.newest) == (1, 2)
    with monkeypatch.context() as m:
        m.setattr(kpi_job, "write_mart", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            refresh_marts(spark, table, marts)
    status = mart_status(spark, marts, table)
    assert status.stale and status.shown is None and "ZeroDivisionError" in status.error
    refresh_marts(spark, table, marts)
    assert not mart_status(spark, marts, table).stale
    assert {r.kpi: r.value for r in read_mart(spark, f"{marts}/kpis").collect()}["total_unidades"] == 9


def test_command_line_chain(spark, write_lines, tmp_path, capsys):
    import json

    from basketry.__main__ import main
    from tests.test_manifest_etl import _setup

    tx, pc, cat = _setup(write_lines)
    table, marts, parts = (str(tmp_path / n) for n in ("t", "m", "p"))
    args = ["etl", "--baskets", tx, "--product-category", pc, "--categories", cat, "--table", table, "--marts", marts, "--partials", parts]
    assert main(args) == 0
    out = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert out["folded"] == [1] and len(out["marts"]) == len(MARTS)
    assert main(args) == 0
    out = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert out["skipped"] and out["marts"] == []
    assert main(["etl", "--baskets", str(tmp_path / "none"), *args[3:]]) == 1
    assert "failed" in json.loads(capsys.readouterr().out.splitlines()[-1])
    assert main(["status", "--table", table, "--marts", marts]) == 0
    out = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert [r["event"] for r in out["runs"]] == ["published"] and not out["marts"]["stale"]
