"""Manifest, change detection and the incremental ETL job."""

import os

import pytest
import time

from pyspark.sql import functions as F

from basketry.plans.etl_job import run_etl
from basketry.sources.manifest import branch_manifest, manifest_diff, source_manifest
from basketry.sources.parquet import read_enriched


def _setup(write_lines):
    tx = write_lines("tx", "102_Tran.csv", ["2013-01-01|102|1|1 2 3", "2013-01-02|102|2|1"])
    write_lines("tx", "103_Tran.csv", ["2013-01-01|103|1|2 2"])
    write_lines("tx", "104_Tran.csv", ["2013-01-03|104|7|3 1"])
    pc = write_lines("pc", "ProductCategory.csv", ["v.Code_pr|v.code", "1|1", "2|2", "2|1"])
    cat = write_lines("cat", "Categories.csv", ["1|Uno", "2|Dos"], newline="\r\n", final_newline=False)
    return tx, pc, cat


def _files(root):
    out = {}
    for d, _, fs in os.walk(root):
        for f in fs:
            if f.endswith(".parquet"):
                p = os.path.join(d, f)
                out[p] = os.stat(p).st_mtime_ns
    return out


def test_manifest_and_diff(spark, write_lines, tmp_path):
    tx, _, _ = _setup(write_lines)
    m = source_manifest(spark, tx)
    assert sorted(r.branch for r in m.collect()) == [102, 103, 104]
    old = branch_manifest(m).collect()
    old_df = spark.createDataFrame(old)
    os.remove(os.path.join(tx, "103_Tran.csv"))
    write_lines("tx", "105_Tran.csv", ["2013-01-01|105|1|1"])
    time.sleep(0.01)
    write_lines("tx", "102_Tran.csv", ["2013-01-01|102|1|1 2 3 4"])
    new_df = branch_manifest(source_manifest(spark, tx))
    diff = {r.branch: r.change for r in manifest_diff(old_df, new_df).collect()}
    assert diff == {102: "modified", 103: "removed", 104: "unchanged", 105: "added"}


def test_incremental_etl(spark, write_lines, tmp_path):
    tx, pc, cat = _setup(write_lines)
    table = str(tmp_path / "table")
    r = run_etl(spark, tx, pc, cat, table)
    assert r.ingested == [102, 103, 104] and not r.skipped
    assert r.metrics == {"lines": 4, "rejected_lines": 0, "units": 8, "units_with_category": 6}
    fact = read_enriched(spark, table)
    assert fact.count() == 8
    assert fact.columns == ["fecha", "sucursal_id", "cliente_id", "producto_id", "cantidad", "categoria_id", "nombre_categoria"]
    names = {r.producto_id: r.nombre_categoria for r in fact.select("producto_id", "nombre_categoria").distinct().collect()}
    assert names == {1: "Uno", 2: "Uno", 3: None}

    # unchanged inputs -> skipped
    assert run_etl(spark, tx, pc, cat, table).skipped

    # branch 102 modified, branch 103 removed: 104's file is not read again, and what was written stays as it is
    before = _files(os.path.join(table, "data"))
    os.remove(os.path.join(tx, "103_Tran.csv"))
    write_lines("tx", "102_Tran.csv", ["2013-01-05|102|9|3"])
    r = run_etl(spark, tx, pc, cat, table)
    assert r.ingested == [102] and r.removed == [103]
    after = _files(os.path.join(table, "data"))
    assert before.items() <= after.items()
    assert {p.split("sucursal_id=")[1].split("/")[0] for p in set(after) - set(before) if "version=2/" in p} == {"102"}
    assert r.metrics["lines"] == 1 and r.touched == [102]
    per = {x.sucursal_id: x.n for x in read_enriched(spark, table).groupBy("sucursal_id").agg(F.count("*").alias("n")).collect()}
    assert per == {102: 1, 104: 2}

    # a dimension change re-ingests every branch
    write_lines("cat", "Categories.csv", ["1|UNO", "2|DOS"])
    r = run_etl(spark, tx, pc, cat, table)
    assert r.ingested == [102, 104]
    assert {x.nombre_categoria for x in read_enriched(spark, table).collect()} == {"UNO", None}


def test_table_is_a_function_of_the_files(spark, write_lines, tmp_path):
    """Lines of a foreign branch stay, unnamed files count, and the table does not depend on the ingest history."""
    tx = write_lines("tx", "102_Tran.csv", ["2013-01-01|102|1|1 2", "2013-01-01|103|2|1 1 1"])
    write_lines("tx", "103_Tran.csv", ["2013-01-01|103|3|2 2"])
    write_lines("tx", "norte_Tran.csv", ["2013-01-01|110|4|1"])
    write_lines("tx", "99999999999999999999_Tran.csv", ["2013-01-01|111|4|1"])
    pc = write_lines("pc", "ProductCategory.csv", ["v.Code_pr|v.code", "1|1"])
    cat = write_lines("cat", "Categories.csv", ["1|Uno"])
    table = str(tmp_path / "table")

    def units(path):
        return {r.sucursal_id: r["count"] for r in read_enriched(spark, path).groupBy("sucursal_id").count().collect()}

    run_etl(spark, tx, pc, cat, table)
    assert units(table) == {102: 2, 103: 5, 110: 1, 111: 1}
    write_lines("tx", "103_Tran.csv", ["2013-01-01|103|3|2 2 2"])
    run_etl(spark, tx, pc, cat, table)
    write_lines("tx", "102_Tran.csv", ["2013-01-01|102|1|1 2"])  # its lines of 103 go
    run_etl(spark, tx, pc, cat, table)
    run_etl(spark, tx, pc, cat, str(tmp_path / "fresh"))
    assert units(table) == units(str(tmp_path / "fresh")) == {102: 2, 103: 3, 110: 1, 111: 1}
    os.remove(os.path.join(tx, "103_Tran.csv"))
    run_etl(spark, tx, pc, cat, str(tmp_path / "fresh"))
    assert units(str(tmp_path / "fresh")) == {102: 2, 110: 1, 111: 1}


def test_failed_write_keeps_the_old_rows(spark, write_lines, tmp_path, monkeypatch):
    from basketry.plans import etl_job

    tx, pc, cat = _setup(write_lines)
    table = str(tmp_path / "table")
    run_etl(spark, tx, pc, cat, table)
    before = read_enriched(spark, table).count()
    write_lines("tx", "102_Tran.csv", ["2013-01-05|102|9|3"])
    monkeypatch.setattr(etl_job, "write_rows", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        run_etl(spark, tx, pc, cat, table)
    monkeypatch.undo()
    assert read_enriched(spark, table).count() == before
    assert run_etl(spark, tx, pc, cat, table).ingested == [102]


def test_time_zone_does_not_matter(spark, write_lines, tmp_path):
    tx, pc, cat = _setup(write_lines)
    table = str(tmp_path / "table")
    run_etl(spark, tx, pc, cat, table)
    spark.conf.set("spark.sql.session.timeZone", "America/Lima")
    try:
        assert run_etl(spark, tx, pc, cat, table).skipped
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_partition_pruning_by_branch(spark, write_lines, tmp_path):
    tx, pc, cat = _setup(write_lines)
    table = str(tmp_path / "table")
    run_etl(spark, tx, pc, cat, table)
    df = read_enriched(spark, table, branches=[104])
    assert {r.sucursal_id for r in df.collect()} == {104}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "sucursal_id" in plan


def test_rejects_table(spark, write_lines, tmp_path):
    tx = write_lines("tx", "102_Tran.csv", ["2013-01-01|102|1|1 2", "2013-01-01|102", "2013-01-02|102|x|1"])
    pc = write_lines("pc", "ProductCategory.csv", ["v.Code_pr|v.code", "1|1"])
    cat = write_lines("cat", "Categories.csv", ["1|Uno"])
    rej = str(tmp_path / "rejects")
    r = run_etl(spark, tx, pc, cat, str(tmp_path / "table"), rejects_path=rej)
    assert (r.metrics["lines"], r.metrics["rejected_lines"]) == (1, 2)
    rows = spark.read.parquet(rej).collect()
    assert len(rows) == 2 and {x.archivo for x in rows} == {"102_Tran.csv"}
    # the same name in another folder of the source; then one is mended, then the other removed
    more = write_lines("tx/norte", "102_Tran.csv", ["2013-01-01|102|x|1"])
    run_etl(spark, tx, pc, cat, str(tmp_path / "table"), rejects_path=rej)
    assert spark.read.parquet(rej).count() == 3
    write_lines("tx", "102_Tran.csv", ["2013-01-01|102|1|1 2", "2013-01-01|102|7|1", "2013-01-02|102|8|1"])
    r = run_etl(spark, tx, pc, cat, str(tmp_path / "table"), rejects_path=rej)
    assert r.metrics["rejected_lines"] == 0
    assert [x.cliente_id for x in spark.read.parquet(rej).collect()] == [None]
    os.remove(os.path.join(more, "102_Tran.csv"))
    run_etl(spark, tx, pc, cat, str(tmp_path / "table"), rejects_path=rej)
    assert spark.read.parquet(rej).count() == 0


def test_json_marts(spark, tmp_path):
    from basketry.plans.catalog import enriched_from_tables
    from basketry.plans.kpi_job import kpi_bundle, run_kpis
    from basketry.sources.parquet import read_mart
    from tests.conftest import SF_SMALL

    f = enriched_from_tables(spark, SF_SMALL)
    root = str(tmp_path / "marts")
    run_kpis(f, root, fmt="json")
    got = {r.kpi: r.value for r in read_mart(spark, f"{root}/kpis", "json").collect()}
    assert got == {r.kpi: r.value for r in kpi_bundle(f).collect()}


def test_command_line(spark, write_lines, tmp_path, capsys):
    from basketry.__main__ import main

    tx, pc, cat = _setup(write_lines)
    table, marts = str(tmp_path / "table"), str(tmp_path / "marts")
    assert main(["etl", "--baskets", tx, "--product-category", pc, "--categories", cat, "--table", table]) == 0
    assert '"ingested": [102, 103, 104]' in capsys.readouterr().out
    assert main(["kpis", "--table", table, "--marts", marts, "--branches", "102,104"]) == 0
    k = {r.kpi: r.value for r in spark.read.parquet(f"{marts}/kpis").collect()}
    assert k["total_unidades"] == 6  # branches 102 (4 units) and 104 (2 units) only


def test_force_reingests_all_and_still_drops_removed(spark, write_lines, tmp_path):
    tx, pc, cat = _setup(write_lines)
    table = str(tmp_path / "table")
    run_etl(spark, tx, pc, cat, table)
    os.remove(os.path.join(tx, "103_Tran.csv"))
    r = run_etl(spark, tx, pc, cat, table, force=True)
    assert (r.ingested, r.removed) == ([102, 104], [103])
    assert sorted(x.sucursal_id for x in read_enriched(spark, table).select("sucursal_id").distinct().collect()) == [102, 104]
