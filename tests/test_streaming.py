"""Structured Streaming ingest equals the batch ETL; restarts add nothing."""

import time

from pyspark.sql import functions as F

from basketry.operators.etl import run_transformations
from basketry.sources.csv import read_baskets
from basketry.sources.parquet import read_enriched
from basketry.streaming.ingest import ingest_stream


def _rows(df):
    return sorted(str(tuple(r)) for r in df.collect())


def test_stream_equals_batch_and_restart(spark, write_lines, tmp_path):
    src = write_lines("tx", "102_Tran.csv", ["2013-01-01|102|1|1 2 3", "2013-01-02|102|2|1", "bad line"])
    write_lines("tx", "103_Tran.csv", ["2013-01-01|103|1|2 2", "2013-13-01|103|1|2"])
    write_lines("tx", "104_Tran.csv", ["2013-01-03|104|7|3 1"])
    pc = spark.createDataFrame([(1, 1), (2, 2), (2, 1)], "producto_id int, categoria_id int")
    cats = spark.createDataFrame([(1, "Uno"), (2, "Dos")], "categoria_id int, nombre_categoria string")
    table, ckpt = str(tmp_path / "table"), str(tmp_path / "ckpt")

    q = ingest_stream(spark, src, pc, cats, table, ckpt, max_files_per_trigger=1)
    assert len([p for p in q.recentProgress if p["numInputRows"] > 0]) == 3  # one file per micro-batch
    batch = run_transformations(read_baskets(spark, src), pc, cats)
    assert _rows(read_enriched(spark, table)) == _rows(batch)

    # restart from the checkpoint: nothing new, nothing duplicated
    ingest_stream(spark, src, pc, cats, table, ckpt, max_files_per_trigger=1)
    assert _rows(read_enriched(spark, table)) == _rows(batch)

    # a new branch file arrives: only it is added
    write_lines("tx", "105_Tran.csv", ["2013-01-04|105|3|1 1"])
    ingest_stream(spark, src, pc, cats, table, ckpt, max_files_per_trigger=1)
    batch = run_transformations(read_baskets(spark, src), pc, cats)
    assert _rows(read_enriched(spark, table)) == _rows(batch)
    assert read_enriched(spark, table).count() == 10


def test_replayed_micro_batch_is_idempotent(spark, write_lines, tmp_path):
    """A micro-batch re-run after a lost executor/driver rewrites its own slice only."""
    from basketry.schemas import RAW_BASKET_SCHEMA, with_corrupt_column
    from basketry.operators.etl import product_categories
    from basketry.streaming.ingest import batch_writer

    pc = spark.createDataFrame([(1, 1), (2, 2)], "producto_id int, categoria_id int")
    cats = spark.createDataFrame([(1, "Uno"), (2, "Dos")], "categoria_id int, nombre_categoria string")
    from basketry.schemas import LOTE_COLUMN

    write = batch_writer(product_categories(pc, cats), str(tmp_path / "t"))
    schema = with_corrupt_column(RAW_BASKET_SCHEMA)
    b0 = spark.createDataFrame([("2013-01-01", 102, 1, "1 2", None), ("2013-01-01", 103, 2, "2", None)], schema)
    b1 = spark.createDataFrame([("2013-01-02", 102, 3, "1 1 1", None)], schema)
    b0, b1 = b0.withColumn(LOTE_COLUMN, F.lit(10)), b1.withColumn(LOTE_COLUMN, F.lit(11))  # two files
    write(b0, 0)
    write(b1, 1)
    once = _rows(read_enriched(spark, str(tmp_path / "t")))
    write(b1, 1)  # replay of epoch 1
    write(b0, 0)  # and of epoch 0
    assert _rows(read_enriched(spark, str(tmp_path / "t"))) == once
    assert len(once) == 6


def test_stream_refreshes_marts(spark, write_lines, tmp_path):
    src = write_lines("tx", "102_Tran.csv", ["2013-01-01|102|1|1 2 3"])
    pc = spark.createDataFrame([(1, 1)], "producto_id int, categoria_id int")
    cats = spark.createDataFrame([(1, "Uno")], "categoria_id int, nombre_categoria string")
    table, ckpt, marts = str(tmp_path / "t"), str(tmp_path / "c"), str(tmp_path / "m")
    ingest_stream(spark, src, pc, cats, table, ckpt, marts_root=marts)
    k = {r.kpi: r.value for r in spark.read.parquet(f"{marts}/kpis").collect()}
    assert k["total_unidades"] == 3
    write_lines("tx", "103_Tran.csv", ["2013-01-02|103|2|1 1"])
    ingest_stream(spark, src, pc, cats, table, ckpt, marts_root=marts)
    k = {r.kpi: r.value for r in spark.read.parquet(f"{marts}/kpis").collect()}
    assert (k["total_unidades"], k["total_visitas"]) == (5, 2)


def test_batch_reingest_replaces_streamed_rows(spark, write_lines, tmp_path):
    """A branch first streamed in, then re-ingested by the batch ETL, is not double counted."""
    from basketry.plans.etl_job import run_etl

    write_lines("tx", "102_Tran.csv", ["2013-01-01|102|1|1 2 3"])
    src = write_lines("tx", "103_Tran.csv", ["2013-01-01|103|1|1 1"])
    pcd = write_lines("pc", "pc.csv", ["v.Code_pr|v.code", "1|1"])
    catd = write_lines("cat", "cat.csv", ["1|Uno"])
    from basketry.sources.csv import read_categories, read_product_category

    table = str(tmp_path / "t")
    q = ingest_stream(spark, src, read_product_category(spark, pcd), read_categories(spark, catd), table,
                      str(tmp_path / "c"), max_files_per_trigger=1)
    assert len([p for p in q.recentProgress if p["numInputRows"] > 0]) == 2
    assert read_enriched(spark, table).count() == 5
    run_etl(spark, src, pcd, catd, table, force=True)
    assert read_enriched(spark, table).count() == 5


def test_new_stream_keeps_batch_rows(spark, write_lines, tmp_path):
    """A stream over another file of a branch adds to what the batch wrote, and a later batch run keeps it."""
    from basketry.plans.etl_job import run_etl
    from basketry.sources.csv import read_categories, read_product_category

    tx = write_lines("tx", "102_Tran.csv", ["2013-01-01|102|1|1 2 3 4 5"])
    more = write_lines("more", "102_Tran.csv", ["2013-01-02|102|1|1"])
    pcd = write_lines("pc", "pc.csv", ["v.Code_pr|v.code", "1|1"])
    catd = write_lines("cat", "cat.csv", ["1|Uno"])
    table = str(tmp_path / "t")
    run_etl(spark, tx, pcd, catd, table)
    ingest_stream(spark, more, read_product_category(spark, pcd), read_categories(spark, catd), table, str(tmp_path / "c"))
    assert read_enriched(spark, table).count() == 6
    assert run_etl(spark, tx, pcd, catd, table).skipped
    run_etl(spark, tx, pcd, catd, table, force=True)
    assert read_enriched(spark, table).count() == 6


def test_first_batch_keeps_a_streams_rows(spark, write_lines, tmp_path):
    """A stream over one folder, then the first batch run over another folder with a file of the same name."""
    from basketry.plans.etl_job import run_etl
    from basketry.sources.csv import read_categories, read_product_category

    b = write_lines("b", "102_Tran.csv", ["2013-01-01|102|1|1 2"])
    c = write_lines("c", "102_Tran.csv", ["2013-01-02|103|1|1"])
    pcd = write_lines("pc", "pc.csv", ["v.Code_pr|v.code", "1|1"])
    catd = write_lines("cat", "cat.csv", ["1|Uno"])
    table = str(tmp_path / "t")
    ingest_stream(spark, b, read_product_category(spark, pcd), read_categories(spark, catd), table, str(tmp_path / "c1"))
    run_etl(spark, c, pcd, catd, table)
    assert {r.sucursal_id: r["count"] for r in read_enriched(spark, table).groupBy("sucursal_id").count().collect()} == {102: 2, 103: 1}


def test_rejects_and_counts_equal_the_batch(spark, write_lines, tmp_path):
    from basketry.plans.etl_job import run_etl
    from basketry.sources.csv import read_categories, read_product_category
    from basketry.sources.snapshots import snapshot
    from basketry.streaming.ingest import LineCounts

    src = write_lines("tx", "102_Tran.csv", ["2013-01-01|102|1|1 2", "bad", "2013-01-01|102|x|1"])
    write_lines("tx", "103_Tran.csv", ["2013-01-01|103|1|1", "2013-01-01|103|1|1|9"])
    write_lines("tx", "104_Tran.csv", ["worse"])
    pcd = write_lines("pc", "pc.csv", ["v.Code_pr|v.code", "1|1"])
    catd = write_lines("cat", "cat.csv", ["1|Uno"])
    streamed, batch = str(tmp_path / "s"), str(tmp_path / "b")
    listener = LineCounts()
    spark.streams.addListener(listener)
    try:
        ingest_stream(spark, src, read_product_category(spark, pcd), read_categories(spark, catd), streamed, str(tmp_path / "c"), 1)
        r = run_etl(spark, src, pcd, catd, batch)
        for _ in range(100):  # events arrive on a thread of their own
            if len(listener.batches) == 3:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert listener.totals() == {"lines": 2, "rejected_lines": 4} == {k: r.metrics[k] for k in ("lines", "rejected_lines")}
    assert _rows(snapshot(spark, streamed).rejects()) == _rows(snapshot(spark, batch).rejects())
    assert _rows(read_enriched(spark, streamed)) == _rows(read_enriched(spark, batch))
    # the batch job over the files that the stream has taken in finds nothing to read but the dimensions' first sight
    assert run_etl(spark, src, pcd, catd, streamed, origin="another").metrics["lines"] == 2


def test_watch_applies_changes_and_deletions(spark, write_lines, tmp_path):
    """A rewritten and a deleted file change the table under a running query; a restart adds nothing."""
    import os

    from basketry.sources.runlog import read_log
    from basketry.sources.snapshots import snapshot
    from basketry.streaming.ingest import watch_sources

    src = write_lines("tx", "102_Tran.csv", ["2013-01-01|102|1|1 2"])
    write_lines("tx", "103_Tran.csv", ["2013-01-01|103|1|1"])
    pcd = write_lines("pc", "pc.csv", ["v.Code_pr|v.code", "1|1"])
    catd = write_lines("cat", "cat.csv", ["1|Uno"])
    table, checkpoint = str(tmp_path / "t"), str(tmp_path / "c")

    def wait_for(want):
        for _ in range(300):
            got = {r.sucursal_id: r["count"] for r in read_enriched(spark, table).groupBy("sucursal_id").count().collect()} if os.path.exists(table) and snapshot(spark, table).version else {}
            if got == want:
                return
            time.sleep(0.1)
        raise AssertionError(got)

    query = watch_sources(spark, src, pcd, catd, table, checkpoint, interval="200 milliseconds")
    try:
        wait_for({102: 2, 103: 1})
        write_lines("tx", "102_Tran.csv", ["2013-01-01|102|1|1 2 3 4", "2013-01-01|104|1|1"])
        wait_for({102: 4, 103: 1, 104: 1})
        os.remove(os.path.join(src, "103_Tran.csv"))
        wait_for({102: 4, 104: 1})
    finally:
        query.stop()
    before = snapshot(spark, table).version
    query = watch_sources(spark, src, pcd, catd, table, checkpoint, interval="200 milliseconds")
    try:
        for _ in range(150):
            time.sleep(0.2)
            if len([p for p in query.recentProgress if "addBatch" in p["durationMs"]]) >= 2:
                break
        assert len(query.recentProgress) >= 2
    finally:
        query.stop()
    assert snapshot(spark, table).version == before
    assert read_log(spark, table).filter("event = 'published' and job = 'etl'").count() == 3


def test_command_line_stream(spark, write_lines, tmp_path):
    from basketry.__main__ import main

    src = write_lines("tx", "102_Tran.csv", ["2013-01-01|102|1|1 2 3"])
    pc = write_lines("pc", "pc.csv", ["v.Code_pr|v.code", "1|1"])
    cat = write_lines("cat", "cat.csv", ["1|Uno"])
    table, ckpt, marts = str(tmp_path / "t"), str(tmp_path / "c"), str(tmp_path / "m")
    args = ["stream", "--baskets", src, "--product-category", pc, "--categories", cat,
            "--table", table, "--checkpoint", ckpt, "--marts", marts]
    assert main(args) == 0
    assert read_enriched(spark, table).count() == 3
    assert {r.kpi: r.value for r in spark.read.parquet(f"{marts}/kpis").collect()}["total_unidades"] == 3
