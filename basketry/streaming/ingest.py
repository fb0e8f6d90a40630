"""Receipt files -> the versioned fact table, with Structured Streaming.

Two sources:

* :func:`ingest_stream`: the file source, for files that only ever arrive.  It remembers which files it has processed (in
  the checkpoint), so a restart adds nothing twice.
* :func:`watch_sources`: a clock that triggers the manifest-driven ETL, for files that are also rewritten or deleted.  Its
  offsets are the manifest that the table's version was built from, so a restart continues exactly there.

Each micro-batch goes through the same ETL as the batch path and is published as one version; a replayed micro-batch
supersedes the slices of its own files with the same rows, and neither the batch job's slices nor another stream's are
touched unless a file of the same source is the same.  Malformed lines go to the table's rejects, as in the batch.
"""

from __future__ import annotations

import json
import time

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from basketry.operators.etl import product_categories, transform_lines
from basketry.plans.etl_job import UNNAMED, run_etl
from basketry.schemas import LOTE_COLUMN
from basketry.sources.csv import accepted_baskets, basket_accepted, basket_stream_reader, rejected_baskets, with_slice
from basketry.sources.manifest import branch_of, fingerprint, relative_file, source_root
from basketry.sources.runlog import claimed
from basketry.sources.snapshots import compact, is_crowded, publish, slice_units, snapshot, write_rejects, write_rows

#: Name of the line counts in the progress of a stream.
LINE_COUNTS = "receipt_lines"
#: How long a micro-batch waits for another run on the table.
WAIT_SECONDS = 600.0


class LineCounts(StreamingQueryListener):
    """Accepted and rejected lines of every micro-batch of the streams of a session (``spark.streams.addListener``)."""

    def __init__(self) -> None:
        self.batches: list[dict] = []

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        counts = event.progress.observedMetrics.get(LINE_COUNTS)
        if counts is not None and event.progress.numInputRows:
            self.batches.append({"query": str(event.progress.id), "batch": event.progress.batchId, **counts.asDict()})

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def totals(self) -> dict[str, int]:
        return {k: sum(b[k] for b in self.batches) for k in ("lines", "rejected_lines")}


def ingest_stream(
    spark: SparkSession,
    source_dir: str,
    product_category: DataFrame,
    categories: DataFrame,
    table_path: str,
    checkpoint_path: str,
    max_files_per_trigger: int | None = None,
    pattern: str = "*.csv",
    available_now: bool = True,
    marts_root: str | None = None,
    marts_every_seconds: float = 600.0,
    origin: str | None = None,
) -> StreamingQuery:
    """Start the ingest query; with ``available_now`` it drains what is there and stops.

    ``source_dir`` may be a glob (e.g. ``dir/*/`` for one folder per branch);
    ``origin`` names the source as in the batch job.  With ``marts_root`` the
    marts follow: once after a drain, and in a running stream when the last
    refresh is ``marts_every_seconds`` old; until then they are marked stale.
    Returns the StreamingQuery (already terminated when ``available_now``).
    """
    reader = basket_stream_reader(spark, pattern)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    origin = origin or source_root(source_dir)
    raw = with_file(with_slice(reader.csv(source_dir), source_dir, origin), source_dir).observe(
        LINE_COUNTS,
        F.count(F.when(basket_accepted(), F.lit(1))).alias("lines"),
        F.count(F.when(~basket_accepted(), F.lit(1))).alias("rejected_lines"),
    )

    # products with their categories are computed once and kept for the query's life,
    # not recomputed per micro-batch (a lost block is rebuilt from lineage).
    # A running stream keeps the dimensions it started with: after a change of
    # the dimension files, restart it (the batch ETL re-ingests every branch).
    products = product_categories(product_category, categories).persist(StorageLevel.MEMORY_AND_DISK)
    writer = raw.writeStream.foreachBatch(
        batch_writer(products, table_path, origin, None if available_now else marts_root, marts_every_seconds)
    ).option("checkpointLocation", checkpoint_path)
    if available_now:
        try:
            query = writer.trigger(availableNow=True).start()
            query.awaitTermination()
            if marts_root:
                from basketry.plans.kpi_job import refresh_marts

                refresh_marts(spark, table_path, marts_root, wait_seconds=WAIT_SECONDS)
        finally:
            products.unpersist()
    else:
        query = writer.trigger(processingTime="30 seconds").start()
    return query


def with_file(lines: DataFrame, path: str) -> DataFrame:
    """Lines with what identifies their file: name, path below the source's root, size and modification time."""
    m = F.col("_metadata")
    return lines.withColumn("archivo", m["file_name"]).withColumn(
        "__file",
        F.struct(
            relative_file(m["file_path"], source_root(path)).alias("file"), m["file_size"].alias("size"),
            m["file_modification_time"].alias("mtime"),
        ),
    )


def batch_writer(
    products: DataFrame, table_path: str, origin: str = "stream", marts_root: str | None = None, marts_every_seconds: float = 0.0
):
    """The ``foreachBatch`` function: ETL of one micro-batch of raw lines, published as the slices of its source files.

    Calling it again with the same rows leaves the table's content as it is after the first call.
    """
    refreshed = [0.0]

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        # computed once, for the rows, the rejects and the files
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            if not batch.limit(1).count():
                return
            with claimed(spark, table_path, "stream", wait_seconds=WAIT_SECONDS) as run:
                base = snapshot(spark, table_path)
                write_rows(transform_lines(accepted_baskets(batch), products), table_path, run.version)
                write_rejects(rejected_baskets(batch.withColumn("archivo", _name(batch))), table_path, run.version)
                files = _files(batch, origin).join(slice_units(spark, table_path, run.version), LOTE_COLUMN, "left")
                state = base.state().filter("kind != 'dead'")
                again = files.select(LOTE_COLUMN)
                kept = state.join(again, LOTE_COLUMN, "left_anti").unionByName(
                    files.withColumn("held", F.lit(run.version)), allowMissingColumns=True
                )
                publish(run, base, kept, state.join(again, LOTE_COLUMN, "left_semi"), {"epoch": epoch_id})
        finally:
            batch.unpersist()
        if is_crowded(run.detail):
            compact(spark, table_path)
        if marts_root and time.monotonic() - refreshed[0] >= marts_every_seconds:
            from basketry.plans.kpi_job import refresh_marts

            refresh_marts(spark, table_path, marts_root, wait_seconds=WAIT_SECONDS)
            refreshed[0] = time.monotonic()

    return write_batch


def _name(batch: DataFrame):
    return F.col("archivo") if "archivo" in batch.columns else F.lit(None).cast("string")


def _files(batch: DataFrame, origin: str) -> DataFrame:
    """The files of a micro-batch as rows of the table's state, one a slice."""
    if "__file" in batch.columns:
        f = F.first("__file")
        one = batch.groupBy(LOTE_COLUMN).agg(f["file"].alias("file"), f["size"].alias("size"), f["mtime"].alias("mtime"))
    else:
        one = batch.select(
            LOTE_COLUMN, F.lit("").alias("file"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("timestamp").alias("mtime")
        ).distinct()
    return one.select(
        F.lit("receipts").alias("kind"), F.lit(origin).alias("origin"), LOTE_COLUMN, "file",
        F.coalesce(branch_of(F.col("file")), F.lit(UNNAMED)).alias("branch"), "size",
        fingerprint(F.col("file"), F.col("size"), F.col("mtime")).alias("fingerprint"),
    )


def watch_sources(
    spark: SparkSession,
    baskets_path: str,
    product_category_path: str,
    categories_path: str,
    table_path: str,
    checkpoint_path: str,
    interval: str = "30 seconds",
    origin: str | None = None,
    marts_root: str | None = None,
) -> StreamingQuery:
    """A running query that applies every change of the files: added, rewritten and deleted ones, and the dimensions.

    Each tick compares the files' manifest with the one that the table's version holds and runs the ETL over the
    difference; nothing changes between ticks that find none.  With ``marts_root`` the marts follow every change.
    Stop it with ``query.stop()``.
    """

    def tick(_: DataFrame, epoch_id: int) -> None:
        result = run_etl(
            spark, baskets_path, product_category_path, categories_path, table_path, origin=origin, wait_seconds=WAIT_SECONDS
        )
        if marts_root:
            from basketry.plans.kpi_job import refresh_marts

            refresh_marts(spark, table_path, marts_root, wait_seconds=WAIT_SECONDS)
        if not result.skipped:
            print(json.dumps({"epoch": epoch_id, "version": result.version, "metrics": result.metrics}))

    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return (
        clock.writeStream.foreachBatch(tick)
        .option("checkpointLocation", checkpoint_path)
        .trigger(processingTime=interval)
        .start()
    )
