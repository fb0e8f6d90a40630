"""The versioned table: whole versions for readers, exclusive runs, sources that do not touch each other, compaction."""

import os

import pytest
from pyspark.sql import functions as F

from basketry.plans import etl_job
from basketry.plans.etl_job import run_etl
from basketry.sources.manifest import relative_file, source_manifest, source_root
from basketry.sources.runlog import RunningJob, append_event, claimed, read_log, runs
from basketry.sources.snapshots import compact, snapshot, vacuum
from tests.test_manifest_etl import _files, _setup


def _units(spark, table, version=None):
    from basketry.sources.snapshots import current

    fact = current(spark, table, version).fact()
    return {r.sucursal_id: r["count"] for r in fact.groupBy("sucursal_id").count().collect()}


class Killed(BaseException):
    """Ends a run like a kill: nothing catches it."""


def test_killed_run_leaves_no_trace(spark, write_lines, tmp_path, monkeypatch):
    tx, pc, cat = _setup(write_lines)
    table = str(tmp_path / "t")
    run_etl(spark, tx, pc, cat, table)
    before, pinned = _units(spark, table), snapshot(spark, table)
    write_lines("tx", "102_Tran.csv", ["2013-01-05|102|9|3"])
    os.remove(os.path.join(tx, "103_Tran.csv"))
    after = {102: 1, 104: 2}
    # killed after the rows are written, before the version is published; the claim stays open
    with monkeypatch.context() as m:

        def kill(*_):
            raise Killed

        m.setattr(etl_job, "publish", kill)
        m.setattr("basketry.sources.runlog.append_event", lambda *a: None if a[4] == "failed" else append_event(*a))
        with pytest.raises(Killed):
            run_etl(spark, tx, pc, cat, table)
    assert _units(spark, table) == before
    with pytest.raises(RunningJob):
        run_etl(spark, tx, pc, cat, table)
    run_etl(spark, tx, pc, cat, table, takeover=True)
    assert _units(spark, table) == after
    # a reader that pinned the old version still sees it whole
    assert {r.sucursal_id: r["count"] for r in pinned.fact().groupBy("sucursal_id").count().collect()} == before
    ends = [(r.job, r.event) for r in runs(spark, table).collect()]
    assert sorted(e for e in ends if e[0] != "compact") == [("etl", "broken"), ("etl", "published"), ("etl", "published")]


def test_second_run_is_refused_and_failures_are_logged(spark, write_lines, tmp_path):
    tx, pc, cat = _setup(write_lines)
    table = str(tmp_path / "t")
    with claimed(spark, table, "first") as run:
        run.event = "unchanged"
        with pytest.raises(RunningJob):
            run_etl(spark, tx, pc, cat, table)
    with pytest.raises(ValueError):
        with claimed(spark, table, "second"):
            raise ValueError("no disk")
    run_etl(spark, tx, pc, cat, table)
    ends = {r.job: (r.event, r.detail) for r in runs(spark, table).collect()}
    assert ends["first"][0] == "unchanged" and ends["etl"][0] == "published"
    assert ends["second"][0] == "failed" and "no disk" in ends["second"][1]


def test_broken_run_cannot_publish(spark, tmp_path):
    table = str(tmp_path / "t")
    with pytest.raises(RunningJob):
        with claimed(spark, table, "slow"):
            with claimed(spark, table, "impatient", takeover=True) as run:
                run.event = "unchanged"
    assert read_log(spark, table).filter("event = 'published'").count() == 0


def test_sources_keep_to_their_own_files(spark, write_lines, tmp_path):
    a = write_lines("a", "102_Tran.csv", ["2013-01-01|102|1|1 2"])
    b = write_lines("b", "102_Tran.csv", ["2013-01-01|103|1|1"])
    _, pc, cat = _setup(write_lines)
    table = str(tmp_path / "t")
    run_etl(spark, a, pc, cat, table)
    run_etl(spark, b, pc, cat, table)
    assert _units(spark, table) == {102: 2, 103: 1}
    os.remove(os.path.join(b, "102_Tran.csv"))
    write_lines("b", "9_Tran.csv", ["2013-01-01|9|1|1 1 1"])
    run_etl(spark, b, pc, cat, table)
    assert _units(spark, table) == {102: 2, 9: 3}
    assert run_etl(spark, a, pc, cat, table).skipped


def test_moved_folder_is_unchanged(spark, write_lines, tmp_path):
    tx, pc, cat = _setup(write_lines)
    table = str(tmp_path / "t")
    run_etl(spark, tx, pc, cat, table, origin="tiendas")
    os.rename(tx, str(tmp_path / "moved"))
    assert run_etl(spark, str(tmp_path / "moved"), pc, cat, table, origin="tiendas").skipped


def test_odd_folder_names(spark, write_lines, tmp_path):
    """Files below folders with odd names are known by their relative path and read again one by one."""
    folders = ["plain", "with space", "a%20b", "x{1}", "tienda#1", "año", "b[2]", "why?"]
    for i, folder in enumerate(folders):
        tx = write_lines(f"in/{folder}", f"{i}_Tran.csv", [f"2013-01-01|{i}|1|1"])
    tx = str(tmp_path / "in")
    _, pc, cat = _setup(write_lines)
    table = str(tmp_path / "t")
    run_etl(spark, tx, pc, cat, table)
    assert _units(spark, table) == {i: 1 for i in range(8)}
    for i in range(1, 8):
        write_lines(f"in/{folders[i]}", f"{i}_Tran.csv", [f"2013-01-01|{i}|1|1 1 1"])
    r = run_etl(spark, tx, pc, cat, table)
    assert (r.ingested, r.metrics["units"]) == (list(range(1, 8)), 21)
    assert _units(spark, table) == {0: 1, **{i: 3 for i in range(1, 8)}}


def test_relative_paths(spark, write_lines, tmp_path):
    tx = write_lines("in put/b", "102_Tran.csv", ["x"])
    files = {r.file for r in source_manifest(spark, str(tmp_path / "in put")).collect()}
    assert files == {"b/102_Tran.csv"} == {r.file for r in source_manifest(spark, f"file://{tmp_path}/in put/").collect()}
    assert source_root("hdfs://nn:8020/a//b/*/c") == "/a/b/" == source_root("/a/b/") and source_root("s3a://bucket/a b") == "/a%20b/"
    uri = F.lit("file:///x/y/z.csv")
    assert spark.range(1).select(relative_file(uri, "/x/"), relative_file(uri, "/q/")).first()[:] == ("y/z.csv", "file:///x/y/z.csv")
    assert os.path.exists(tx)


def test_only_changed_files_are_opened(spark, write_lines):
    """A filter on the file's path picks the files before the scan opens any."""
    from basketry.sources.csv import scan_baskets

    tx, _, _ = _setup(write_lines)
    uri = [r.uri for r in source_manifest(spark, tx).collect() if r.branch == 103]
    scan = scan_baskets(spark, tx).filter(F.col("_metadata.file_path").isin(uri))
    assert len(scan.collect()) == 1
    leaf = scan._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert leaf.metrics().apply("numFiles").value() == 1


def test_versions_to_merge():
    from basketry.sources.snapshots import _worth_merging

    assert _worth_merging({1: 100, 2: 1, 3: 1, 4: 1}, set(), 8) == [2, 3, 4]
    assert _worth_merging({1: 100, 2: 30, 3: 7}, set(), 8) == []  # each outweighs the smaller ones
    assert _worth_merging({1: 100, 2: 30, 3: 7}, {1}, 8) == [1]
    assert _worth_merging({v: 2**v for v in range(12)}, set(), 8) == [0, 1, 2, 3, 4]
    assert _worth_merging({1: 5, 2: 0}, set(), 1) == [1, 2]


def test_compaction_keeps_content_and_bounds_files(spark, write_lines, tmp_path):
    tx, pc, cat = _setup(write_lines)
    table = str(tmp_path / "t")
    for day in range(1, 4):  # a run per file of one branch
        write_lines("tx", f"day{day}_102_Tran.csv", [f"2013-02-{day:02d}|102|{day}|1 2", "bad"])
        run_etl(spark, tx, pc, cat, table)
    write_lines("tx", "day3_102_Tran.csv", ["2013-02-03|102|3|1"])
    run_etl(spark, tx, pc, cat, table)
    before, rejects = _units(spark, table), snapshot(spark, table).rejects().count()
    assert (before, rejects) == ({102: 4 + 2 * 2 + 1, 103: 2, 104: 2}, 2)
    assert compact(spark, table, max_versions=1) is not None
    at = snapshot(spark, table)
    assert len(at.versions) == 1 and at.dead == 0
    assert _units(spark, table) == before and at.rejects().count() == rejects
    files = [f for f in _files(os.path.join(table, "data")) if f"version={at.versions[0]}/" in f]
    assert len(files) <= 3  # one a branch, though six source files hold them
    assert run_etl(spark, tx, pc, cat, table).skipped
    # what no snapshot reads any more can be emptied
    assert vacuum(spark, table, keep=1)
    assert _units(spark, table) == before
    left = [f for f in _files(os.path.join(table, "data")) if f"version={at.versions[0]}/" not in f]
    assert left == [] and vacuum(spark, table, keep=1) == []


def test_empty_and_rejected_files(spark, write_lines, tmp_path):
    """Files without a line, with rejects alone, and a table that loses all its files."""
    tx, pc, cat = _setup(write_lines)
    os.remove(os.path.join(tx, "104_Tran.csv"))
    write_lines("tx", "102_Tran.csv", [""])
    write_lines("tx", "103_Tran.csv", ["bad"])
    table = str(tmp_path / "t")
    run_etl(spark, tx, pc, cat, table)
    at = snapshot(spark, table)
    assert at.fact().count() == 0 and at.rejects().count() == 1
    assert run_etl(spark, tx, pc, cat, table).skipped
    os.remove(os.path.join(tx, "103_Tran.csv"))
    run_etl(spark, tx, pc, cat, table)
    assert snapshot(spark, table).rejects().count() == 0
