"""ETL job: receipt files -> the versioned, branch-partitioned fact table.

The table is a function of the input files: every accepted line is kept under
its own branch, whichever file holds it, in the slice of its source file.

* files that were added or changed since the table's version are read; their rows, and the lines they reject, become a new
  version that supersedes their old slices, and so do the slices of removed files;
* the manifest that was ingested is published with the rows, so a killed run leaves no trace and is simply repeated;
* a change of the dimension files, or ``force``, reads all files of this source again;
* the files of other sources (other ``origin``: a stream over another folder, another job) are never touched.

What reaches the driver: one row per branch and kind of change, the paths of the
files to read again when few files changed, and counts.  Never data.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from basketry.operators.etl import product_categories, transform_lines
from basketry.schemas import LOTE_COLUMN
from basketry.sources.csv import (
    accepted_baskets,
    basket_accepted,
    read_categories,
    read_product_category,
    rejected_baskets,
    scan_baskets,
    with_slice,
)
from basketry.sources.manifest import manifest_diff, source_manifest, source_root
from basketry.sources.runlog import Run, claimed, no_rows
from basketry.sources.snapshots import (
    DATA_SCHEMA,
    PARTITION_COLUMN,
    REJECT_SCHEMA,
    Snapshot,
    compact,
    is_crowded,
    publish,
    slice_units,
    snapshot,
    write_rejects,
    write_rows,
)

#: Branch of receipt files that name none.
UNNAMED = -2
#: Up to so many changed files are picked by their paths, which prunes the others before they are opened.
FILES_BY_PATH = 10_000


@dataclass
class EtlResult:
    ingested: list[int] = field(default_factory=list)
    removed: list[int] = field(default_factory=list)
    skipped: bool = False
    # accepted receipt lines and written units, observed during the write
    # itself (no extra scan, unlike a count() on the source)
    metrics: dict = field(default_factory=dict)
    #: The table's version after the run, and the branches of the rows it wrote.
    version: int = 0
    touched: list[int] = field(default_factory=list)


@dataclass
class _Changes:
    """What differs between a snapshot and the files that are there."""

    base: Snapshot
    files: DataFrame  # slice, change
    counts: list  # branch, change, n
    dimensions: bool

    def count(self, *kinds: str) -> int:
        return sum(r["n"] for r in self.counts if r["change"] in kinds)

    @property
    def none(self) -> bool:
        return not self.dimensions and self.count("added", "modified", "removed") == 0


def _as_state(manifest: DataFrame, kind: str, origin: str) -> DataFrame:
    return manifest.select(
        F.lit(kind).alias("kind"), F.lit(origin).alias("origin"), F.col("slice").alias(LOTE_COLUMN), "file",
        F.coalesce("branch", F.lit(UNNAMED)).alias("branch"), "size", "fingerprint",
    )


def _changes(base: Snapshot, receipts: DataFrame, dimensions: DataFrame, origin: str, force: bool) -> _Changes:
    own = base.state().filter(F.col("origin") == origin)
    before = own.filter("kind = 'receipts'").select(F.col(LOTE_COLUMN).alias("slice"), "branch", "fingerprint")
    # two rows on either side as a rule: the dimension files
    known = own.filter("kind = 'dimension'").select(LOTE_COLUMN, "fingerprint")
    both = known.withColumn("side", F.lit(1)).union(dimensions.select(LOTE_COLUMN, "fingerprint", F.lit(2)))
    sides = both.groupBy(LOTE_COLUMN, "fingerprint").agg(F.sum("side").alias("sides"))
    moved = force or base.version == 0 or sides.filter("sides != 3").limit(1).count() > 0
    diff = manifest_diff(before, receipts.withColumnRenamed(LOTE_COLUMN, "slice"), "slice", "branch").select("slice", "branch", "change")
    if moved:  # every file that is there is read again
        diff = diff.withColumn("change", F.when(F.col("change") == "unchanged", "modified").otherwise(F.col("change")))
    diff = diff.persist()  # a row per file
    counts = diff.groupBy("branch", "change").agg(F.count(F.lit(1)).alias("n")).collect()
    return _Changes(base, diff, counts, moved)


def run_etl(
    spark: SparkSession,
    baskets_path: str,
    product_category_path: str,
    categories_path: str,
    table_path: str,
    force: bool = False,
    rejects_path: str | None = None,
    origin: str | None = None,
    takeover: bool = False,
    wait_seconds: float = 0.0,
    pattern: str = "*.csv",
) -> EtlResult:
    """Bring the table up to the files; the run's claim keeps other runs out, see :mod:`basketry.sources.runlog`.

    ``origin`` names the source (default: its folder); files keep their slices under that name, wherever they lie.
    ``pattern`` selects the receipt files by name.
    ``rejects_path``: also write the rejected lines that are live after the run there, whole.
    """
    origin = origin or source_root(baskets_path)
    # Listing happens once, when the manifests are created: the file index is
    # a fixed snapshot taken before any data is read, so the state published
    # at the end describes exactly what was ingested.
    listed = source_manifest(spark, baskets_path, pattern, origin)
    receipts = _as_state(listed, "receipts", origin)
    dimensions = _as_state(
        source_manifest(spark, product_category_path, origin="product_category")
        .union(source_manifest(spark, categories_path, origin="categories")),
        "dimension", origin,
    )
    found = _changes(snapshot(spark, table_path), receipts, dimensions, origin, force)
    try:
        if found.none and found.base.version:
            return EtlResult(skipped=True, version=found.base.version)
        with claimed(spark, table_path, "etl", takeover, wait_seconds) as run:
            if run.before != found.base.version:  # another run ended in between
                found.files.unpersist()
                found = _changes(snapshot(spark, table_path), receipts, dimensions, origin, force)
            result = _ingest(spark, run, found, listed, receipts, dimensions, origin, (baskets_path, product_category_path, categories_path), pattern)
    finally:
        # Spark takes two listings of one folder for the same plan: a cached difference must not outlive its run
        found.files.unpersist()
    if is_crowded(run.detail):
        compact(spark, table_path)
    if rejects_path:
        snapshot(spark, table_path).rejects().write.mode("overwrite").parquet(rejects_path)
    return result


def _ingest(
    spark: SparkSession, run: Run, found: _Changes, listed: DataFrame, receipts: DataFrame, dimensions: DataFrame, origin: str,
    paths: tuple[str, str, str], pattern: str,
) -> EtlResult:
    """Read the changed files, write their rows and publish the state after the run."""
    baskets_path, product_category_path, categories_path = paths
    table_path, base = run.root, found.base
    branches = lambda *kinds: sorted({r["branch"] for r in found.counts if r["change"] in kinds})
    result = EtlResult(branches("added", "modified"), version=run.version)
    result.removed = sorted(set(branches("removed")) - set(branches("added", "modified", "unchanged")))
    changed = found.files.filter(F.col("change").isin("added", "modified")).select(F.col("slice").alias(LOTE_COLUMN))
    if found.count("added", "modified"):
        lines = _changed_lines(scan_baskets(spark, baskets_path, pattern), baskets_path, origin, found, listed, changed)
        units, result.metrics, result.touched = _write(spark, table_path, run.version, lines, product_category_path, categories_path)
    else:  # files went, none came: nothing to read
        write_rows(no_rows(spark, DATA_SCHEMA), table_path, run.version)
        write_rejects(no_rows(spark, REJECT_SCHEMA), table_path, run.version)
        units = no_rows(spark, f"{LOTE_COLUMN} long, units long")
        result.metrics = dict.fromkeys(("lines", "rejected_lines", "units", "units_with_category"), 0)
    new = receipts.join(changed, LOTE_COLUMN, "left_semi").join(units, LOTE_COLUMN, "left").withColumn("held", F.lit(run.version))
    state = base.state().filter("kind != 'dead'")
    mine = (F.col("origin") == origin) & (F.col("kind") == "receipts")
    gone = found.files.filter(F.col("change") != "unchanged").select(F.col("slice").alias(LOTE_COLUMN))
    kept = (
        state.filter(mine).join(gone, LOTE_COLUMN, "left_anti")
        .unionByName(new, allowMissingColumns=True)
        .unionByName(state.filter(~mine & ~((F.col("kind") == "dimension") & (F.col("origin") == origin))), allowMissingColumns=True)
        .unionByName(dimensions, allowMissingColumns=True)
    )
    publish(run, base, kept, state.filter(mine).join(gone, LOTE_COLUMN, "left_semi"), result.metrics)
    units.unpersist()
    return result


def _changed_lines(scan: DataFrame, path: str, origin: str, found: _Changes, listed: DataFrame, changed: DataFrame) -> DataFrame:
    """The lines of the files to read, with their file's name and slice."""
    lines = with_slice(scan.withColumn("archivo", F.col("_metadata.file_name")), path, origin)
    if not found.count("unchanged"):
        return lines
    if found.count("added", "modified") > FILES_BY_PATH:
        return lines.join(changed, LOTE_COLUMN, "left_semi")
    uris = listed.join(changed, listed["slice"] == changed[LOTE_COLUMN], "left_semi").select("uri").collect()
    return lines.filter(F.col("_metadata.file_path").isin([r["uri"] for r in uris]))


def _write(
    spark: SparkSession, table_path: str, version: int, lines: DataFrame, product_category_path: str, categories_path: str
) -> tuple[DataFrame, dict, list[int]]:
    """Write the rows and the rejects of ``lines`` as a version: units by slice (cached), counts, and the branches written."""
    lines_seen, units_seen = Observation("lines"), Observation("units")
    counts = [
        F.count(F.when(basket_accepted(), F.lit(1))).alias("lines"),
        F.count(F.when(~basket_accepted(), F.lit(1))).alias("rejected_lines"),
    ]
    # line counts (accepted and rejected) are observed on the single scan
    products = product_categories(read_product_category(spark, product_category_path), read_categories(spark, categories_path))
    enriched = transform_lines(accepted_baskets(lines.observe(lines_seen, *counts)), products).observe(
        units_seen,
        F.count(F.lit(1)).alias("units"),
        F.count("nombre_categoria").alias("units_with_category"),
        F.collect_set(PARTITION_COLUMN).alias("branches"),
    )
    write_rows(enriched, table_path, version)
    units = slice_units(spark, table_path, version).persist()  # a row per file
    if units.count():
        metrics, seen = lines_seen.get, dict(units_seen.get)
    else:  # Spark replaces a plan that turns out empty, and its observations with it
        metrics, seen = lines.agg(*counts).first().asDict(), {"units": 0, "units_with_category": 0, "branches": []}
    touched = sorted(seen.pop("branches"))
    # the second scan only happens when the first one saw rejects
    write_rejects(rejected_baskets(lines if metrics["rejected_lines"] else lines.limit(0)), table_path, version)
    return units, {**metrics, **seen}, touched
