"""Run log of a table: one appended row per event, so that runs exclude each other and readers see whole versions.

A run claims the next version number, works, and ends with ``published``, ``unchanged`` or ``failed``.  What it wrote counts
from the moment its ``published`` row is there: a row is one file, which Spark's committer puts in place at once.  A run that
sees another one's open claim is refused; two that claim at the same time both are.  A claim left by a killed run is broken
by ``takeover``, after which nothing that run publishes counts.

The log also is the record of runs, failed ones with their error: :func:`runs` gives the newest state of each.
"""

from __future__ import annotations

import datetime as dt
import json
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.operators.jobs import latest_per_key

LOG_SCHEMA = "at timestamp, seq long, run string, job string, event string, version long, detail string"
#: Events that end a run.
CLOSING = ("published", "unchanged", "failed", "broken")


class RunningJob(RuntimeError):
    """Another run has claimed the table."""


@dataclass
class Run:
    """An open claim; what ``detail`` holds when the run ends goes to the log."""

    root: str
    run: str
    job: str
    version: int
    #: The newest version published before.
    before: int = 0
    event: str = "published"
    detail: dict = field(default_factory=dict)


def no_rows(spark: SparkSession, schema: str) -> DataFrame:
    """An empty DataFrame (``name type, ...``) that the optimizer knows to be empty, so that joins with it vanish."""
    columns = [F.lit(None).cast(t).alias(n) for n, t in (c.split() for c in schema.split(", "))]
    return spark.range(0, 1, 1, 1).select(*columns).where(F.lit(False))


def read_log(spark: SparkSession, root: str) -> DataFrame:
    """Every event of a table; none if there is no table yet."""
    try:
        return spark.read.schema(LOG_SCHEMA).parquet(f"{root}/log")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return no_rows(spark, LOG_SCHEMA)


def append_event(spark: SparkSession, root: str, run: str, job: str, event: str, version: int, detail: dict) -> None:
    now, seq = dt.datetime.now(dt.timezone.utc), time.time_ns()
    values = dict(at=now, seq=seq, run=run, job=job, event=event, version=version, detail=json.dumps(detail))
    row = spark.range(0, 1, 1, 1).select(*(F.lit(values[n]).cast(t).alias(n) for n, t in (c.split() for c in LOG_SCHEMA.split(", "))))
    row.write.mode("append").parquet(f"{root}/log")


def _by_run(log: DataFrame) -> DataFrame:
    """(run, version, ended, broken, published): one row a run, ``published`` its published event."""
    published = F.max(F.when(F.col("event") == "published", F.struct("version", "seq", "run", "detail")))
    return log.groupBy("run").agg(
        F.max("version").alias("version"),
        F.max(F.col("event").isin(*CLOSING)).alias("ended"),
        F.max(F.col("event") == "broken").alias("broken"),
        published.alias("published"),
    )


def valid_events(log: DataFrame) -> DataFrame:
    """The log without what broken runs published."""
    broken = log.filter("event = 'broken'").select("run")
    return log.join(broken, "run", "left_anti")


def last_published(spark: SparkSession, root: str, version: int | None = None):
    """(version, seq, run, detail) of the newest published version (or of ``version``), or None."""
    good = _by_run(read_log(spark, root)).filter("published is not null and not broken").select("published.*")
    if version is not None:
        good = good.filter(F.col("version") == version)
    return good.agg(F.max(F.struct("version", "seq", "run", "detail"))).first()[0]


def runs(spark: SparkSession, root: str) -> DataFrame:
    """run, seq, at, job, event, version, detail: the newest event of every run."""
    return latest_per_key(read_log(spark, root), "run", "seq")


def _claims(spark: SparkSession, root: str) -> tuple[list[str], int, int]:
    """Runs without an end (a few at most), the highest version number ever claimed and the newest published one."""
    good = F.when(~F.col("broken"), F.col("published.version"))
    open_runs = F.collect_list(F.when(~F.col("ended"), F.col("run")))
    found = _by_run(read_log(spark, root)).agg(open_runs, F.coalesce(F.max("version"), F.lit(0)), F.coalesce(F.max(good), F.lit(0)))
    return tuple(found.first())


@contextmanager
def claimed(spark: SparkSession, root: str, job: str, takeover: bool = False, wait_seconds: float = 0.0) -> Iterator[Run]:
    """Claim the table's next version for the body; its end is logged, an exception as ``failed``.

    ``wait_seconds``: how long to wait for another run's end before :class:`RunningJob` is raised.
    """
    deadline = time.monotonic() + wait_seconds
    while True:
        others, top, before = _claims(spark, root)
        if others and takeover:
            for other in others:
                append_event(spark, root, other, job, "broken", 0, {"by": job})
            others = []
        if not others:
            mine = Run(root, uuid.uuid4().hex, job, top + 1, before)
            append_event(spark, root, mine.run, job, "claimed", mine.version, {})
            others, _, mine.before = _claims(spark, root)
            others = [r for r in others if r != mine.run]
            if not others:
                break
            append_event(spark, root, mine.run, job, "failed", mine.version, {"error": "refused"})
        if time.monotonic() >= deadline:
            raise RunningJob(f"{root}: run {others[0]} has not ended; use takeover if it was killed")
        time.sleep(min(1.0, max(0.05, deadline - time.monotonic())))
    try:
        yield mine
    except BaseException as error:
        append_event(spark, root, mine.run, job, "failed", mine.version, {"error": f"{type(error).__name__}: {error}"[:2000]})
        raise
    if mine.run not in _claims(spark, root)[0]:
        raise RunningJob(f"{root}: run {mine.run} was taken over")
    append_event(spark, root, mine.run, job, mine.event, mine.version, mine.detail)
