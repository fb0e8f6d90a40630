"""The versioned fact table: a run writes beside what is there, then one log row makes its version the current one.

Under the table's root:

* ``data/version=N/sucursal_id=B``  the fact rows that run N wrote, each with its slice (``lote``, a hash of its file)
* ``rejects/version=N``             the lines that run N could not accept, with their slice
* ``slices/version=N``              the state after run N: every file, its fingerprint and the version that holds its rows,
                                    and the slices of older versions whose rows no longer count
* ``log``                           claims and published versions, see :mod:`basketry.sources.runlog`

A reader pins one version: it reads the folders of the versions that hold live slices, and an anti-join drops superseded
slices (their list is one row a slice, and Spark broadcasts it while it is small).  So readers see all of a run or nothing of
it, and file counts follow bytes and versions, never the number of source files.  :func:`compact` keeps the versions few.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.schemas import CORRUPT_COLUMN, ENRICHED_COLUMNS, LOTE_COLUMN
from basketry.sources.runlog import Run, claimed, last_published, no_rows, read_log, valid_events

PARTITION_COLUMN = "sucursal_id"
DATA_SCHEMA = (
    "fecha date, sucursal_id int, cliente_id int, producto_id int, cantidad int, categoria_id int, nombre_categoria string, lote long"
)
REJECT_SCHEMA = f"archivo string, fecha string, sucursal_id int, cliente_id int, productos_raw string, {CORRUPT_COLUMN} string, lote long"
#: kind: receipts (live files), dimension (dimension files), dead (slices whose rows in ``held`` no longer count).
STATE_SCHEMA = "kind string, origin string, lote long, file string, branch int, size long, fingerprint string, held long, units long"
#: More live versions than this, or more than a fifth of the rows dead, are compacted.
MAX_VERSIONS, DEAD_SHARE = 8, 0.2


@dataclass(frozen=True)
class Snapshot:
    """A pinned version of a table: ``versions`` hold its rows, less ``dead`` superseded slices."""

    spark: SparkSession
    root: str
    version: int = 0
    versions: tuple[int, ...] = ()
    dead: int = 0
    detail: dict = field(default_factory=dict)

    def state(self) -> DataFrame:
        if self.version == 0:
            return no_rows(self.spark, STATE_SCHEMA)
        return self.spark.read.schema(STATE_SCHEMA).parquet(f"{self.root}/slices/version={self.version}")

    def dead_slices(self) -> DataFrame:
        return self.state().filter("kind = 'dead'").select(F.col("held").alias("version"), LOTE_COLUMN)

    def rows(self, part: str, schema: str, versions: Iterable[int] | None = None) -> DataFrame:
        """Live rows of ``data``, ``rejects`` or another folder of the same layout, with ``version`` and ``lote``."""
        return live_rows(self, f"{self.root}/{part}", schema, versions)

    def fact(self, branches: Iterable[int] | None = None) -> DataFrame:
        """The fact's columns; a branch list becomes a partition filter."""
        df = self.rows("data", DATA_SCHEMA)
        if branches is not None:
            df = df.filter(F.col(PARTITION_COLUMN).isin(list(branches)))
        return df.select(*ENRICHED_COLUMNS)

    def rejects(self) -> DataFrame:
        return self.rows("rejects", REJECT_SCHEMA).drop("version", LOTE_COLUMN)


def live_rows(pinned: Snapshot, path: str, schema: str, versions: Iterable[int] | None = None) -> DataFrame:
    """Rows under ``path/version=N`` of the pinned versions (or some of them) without superseded slices."""
    spark = pinned.spark
    wanted = list(pinned.versions if versions is None else versions)
    full = f"{schema}, version long"
    if not wanted:
        return no_rows(spark, full)
    df = spark.read.schema(full).option("basePath", path).parquet(*[f"{path}/version={v}" for v in wanted])
    return df.join(pinned.dead_slices(), ["version", LOTE_COLUMN], "left_anti") if pinned.dead else df


def current(spark: SparkSession, root: str, version: int | None = None) -> Snapshot | None:
    """The newest published version of a table (or ``version``); None if nothing was published."""
    row = last_published(spark, root, version)
    if row is None:
        return None
    detail = json.loads(row["detail"])
    return Snapshot(spark, root, row["version"], tuple(detail["versions"]), detail["dead"], detail)


def snapshot(spark: SparkSession, root: str) -> Snapshot:
    """The newest published version, or the empty table."""
    return current(spark, root) or Snapshot(spark, root)


def write_rows(df: DataFrame, root: str, version: int) -> None:
    """The fact rows of one run; AQE's rebalance splits a dominant branch over many tasks and files."""
    lote = F.col(LOTE_COLUMN) if LOTE_COLUMN in df.columns else F.lit(0)
    (
        df.select(*ENRICHED_COLUMNS, lote.cast("bigint").alias(LOTE_COLUMN))
        .hint("rebalance", PARTITION_COLUMN)
        .write.mode("overwrite")
        .partitionBy(PARTITION_COLUMN)
        .parquet(f"{root}/data/version={version}")
    )


def write_rejects(df: DataFrame, root: str, version: int) -> None:
    """The rejected lines of one run (few as a rule), or none."""
    rows = df.withColumn(LOTE_COLUMN, F.col(LOTE_COLUMN).cast("bigint"))
    rows.write.mode("overwrite").parquet(f"{root}/rejects/version={version}")


def slice_units(spark: SparkSession, root: str, version: int) -> DataFrame:
    """(lote, units) of the rows that a version holds."""
    rows = spark.read.schema(DATA_SCHEMA).parquet(f"{root}/data/version={version}")
    return rows.groupBy(LOTE_COLUMN).agg(F.count(F.lit(1)).alias("units"))


def publish(run: Run, base: Snapshot, kept: DataFrame, superseded: DataFrame, metrics: dict) -> None:
    """Write the state after ``run``: the files ``kept`` (STATE_SCHEMA without dead rows) and the slices ``superseded`` now.

    ``superseded``: (held, lote, units).  Versions without a live slice leave the table with their dead slices.
    """
    columns = [c.split()[0] for c in STATE_SCHEMA.split(", ")]
    files = kept.select(*columns).persist()  # a row per file
    before = base.state().filter("kind = 'dead'").select("held", LOTE_COLUMN, "units")
    gone = before.union(superseded.select("held", LOTE_COLUMN, "units")).withColumn("kind", F.lit("dead")).persist()
    try:
        counted = [df.select("kind", "held", "units") for df in (files.filter("kind = 'receipts'"), gone)]
        totals = counted[0].union(counted[1]).groupBy("kind", "held").agg(F.count(F.lit(1)).alias("n"), F.sum("units").alias("units"))
        totals = totals.collect()  # two rows a version at most
        live = {r["held"]: r["units"] or 0 for r in totals if r["kind"] == "receipts"}
        dead = [r for r in totals if r["kind"] == "dead" and r["held"] in live]
        state = files.unionByName(gone.filter(F.col("held").isin(list(live))), allowMissingColumns=True)
        state.coalesce(1).write.mode("overwrite").parquet(f"{run.root}/slices/version={run.version}")
    finally:
        files.unpersist()
        gone.unpersist()
    run.detail.update(
        base=base.version, versions=sorted(live), units=live, dead=sum(r["n"] for r in dead),
        dead_units=sum(r["units"] or 0 for r in dead), metrics=metrics,
    )


def load(spark: SparkSession, root: str, df: DataFrame, job: str = "load") -> int:
    """Replace the whole table by the rows of ``df`` (with their slices, if it has any); returns the version."""
    with claimed(spark, root, job) as run:
        write_rows(df, root, run.version)
        write_rejects(no_rows(spark, REJECT_SCHEMA), root, run.version)
        kept = slice_units(spark, root, run.version).selectExpr(
            "'receipts' as kind", f"'{job}' as origin", LOTE_COLUMN, "'' as file", "cast(null as int) as branch",
            "cast(null as long) as size", "'' as fingerprint", f"{run.version}L as held", "units",
        )
        publish(run, Snapshot(spark, root), kept, no_rows(spark, "held long, lote long, units long"), {})
    return run.version


def _worth_merging(units: dict[int, int], dirty: set[int], max_versions: int) -> list[int]:
    """The versions to rewrite as one: those with superseded rows, and the small ones up to one as large as they together."""
    ascending = sorted(units, key=lambda v: (units[v], v))
    chosen, smaller = set(dirty), 0
    for place, version in enumerate(ascending):
        if units[version] < smaller:
            chosen |= set(ascending[: place + 1])
        smaller += units[version]
    spare = len(units) - len(chosen) + 1 - max_versions
    rest = [v for v in ascending if v not in chosen]
    return sorted(chosen | set(rest[: max(0, spare)]))


def is_crowded(detail: dict, max_versions: int = MAX_VERSIONS, dead_share: float = DEAD_SHARE) -> bool:
    """Whether a published state has too many versions or superseded rows."""
    return len(detail["versions"]) > max_versions or detail["dead_units"] > dead_share * max(1, sum(detail["units"].values()))


def compact(spark: SparkSession, root: str, max_versions: int = MAX_VERSIONS, dead_share: float = DEAD_SHARE) -> int | None:
    """Rewrite small and partly superseded versions as one, if there are too many; the new version, or None.

    A version that outweighs all smaller ones stays, so a row is rewritten a logarithmic number of times.  Neither the
    table's content nor what is known of its files changes.
    """

    at = current(spark, root)
    if at is None or not is_crowded(at.detail, max_versions, dead_share):
        return None
    with claimed(spark, root, "compact") as run:
        base = snapshot(spark, root)
        units = {int(v): n for v, n in base.detail["units"].items()}
        dirty = {r["held"] for r in base.state().filter("kind = 'dead'").select("held").distinct().collect()}
        picked = _worth_merging(units, dirty, max_versions)
        write_rows(base.rows("data", DATA_SCHEMA, picked), root, run.version)
        write_rejects(base.rows("rejects", REJECT_SCHEMA, picked).drop("version"), root, run.version)
        moved = F.when(F.col("held").isin(picked), F.lit(run.version)).otherwise(F.col("held"))
        kept = base.state().filter("kind != 'dead'").withColumn("held", moved)
        publish(run, base, kept, no_rows(spark, "held long, lote long, units long"), {"compacted": picked})
    return run.version


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> list[int]:
    """Empty the folders of versions that none of the last ``keep`` published snapshots reads; returns them.

    A folder is emptied by overwriting it with no rows, so readers that pinned an older version must have ended.
    """
    with claimed(spark, root, "vacuum") as run:
        run.event = "unchanged"
        log = valid_events(read_log(spark, root))
        newest = log.filter("event = 'published'").orderBy(F.desc("version")).limit(keep).collect()
        read = {v for r in newest for v in json.loads(r["detail"])["versions"]}
        before = F.col("version") < max((r["version"] for r in newest), default=0)
        emptied = {v for r in log.filter("job = 'vacuum' and event = 'unchanged'").collect() for v in json.loads(r["detail"])["emptied"]}
        ended = log.filter(F.col("event").isin("published", "failed") & before).select("version").distinct()
        old = sorted({r["version"] for r in ended.collect()} - read - emptied)
        for version in old:
            write_rows(no_rows(spark, DATA_SCHEMA), root, version)
            write_rejects(no_rows(spark, REJECT_SCHEMA), root, version)
        run.detail["emptied"] = old
    return old
