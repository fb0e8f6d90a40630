"""Command line for the three jobs, meant for ``spark-submit``.

    spark-submit --py-files basketry.zip basketry/__main__.py etl    --baskets DIR --product-category DIR --categories DIR --table DIR [--origin NAME] [--rejects DIR] [--partials DIR] [--marts DIR] [--force] [--takeover]
    spark-submit --py-files basketry.zip basketry/__main__.py kpis   (--table DIR [--branches 102,103] | --partials DIR) --marts DIR [--format parquet|json]
    spark-submit --py-files basketry.zip basketry/__main__.py stream --baskets DIR --product-category DIR --categories DIR --table DIR --checkpoint DIR [--max-files N] [--continuous]
    spark-submit --py-files basketry.zip basketry/__main__.py watch  --baskets DIR --product-category DIR --categories DIR --table DIR --checkpoint DIR [--interval "30 seconds"] [--marts DIR]
    spark-submit --py-files basketry.zip basketry/__main__.py status --table DIR [--marts DIR]

A failed run prints its error as JSON and exits with 1; it is also in the table's log (``status``).  The session comes from the cluster's configuration (``getOrCreate``); nothing
is tuned here.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="basketry")
    sub = p.add_subparsers(dest="cmd", required=True)

    etl = sub.add_parser("etl", help="incremental branch-file ingest into the partitioned table")
    for a in ("--baskets", "--product-category", "--categories", "--table"):
        etl.add_argument(a, required=True)
    etl.add_argument("--origin", help="name of the source; files keep their slices under it, wherever they lie")
    etl.add_argument("--rejects", help="also write the rejected lines that are live there")
    etl.add_argument("--force", action="store_true", help="read every file again")
    etl.add_argument("--takeover", action="store_true", help="break the claim that a killed run left")
    etl.add_argument("--partials", help="also fold the new rows into the KPI partials")
    etl.add_argument("--marts", help="then bring the KPI marts up to the table")

    kpis = sub.add_parser("kpis", help="all KPI and chart marts from the table")
    kpis.add_argument("--table", help="compute from the fact table")
    kpis.add_argument("--partials", help="compute from the per-branch partials instead")
    kpis.add_argument("--marts", required=True)
    kpis.add_argument("--format", default="parquet", choices=["parquet", "json"])
    kpis.add_argument("--branches", help="comma-separated branch ids (partition pruning)")
    kpis.add_argument("--parallelism", type=int, default=4)

    st = sub.add_parser("stream", help="Structured Streaming ingest of new branch files")
    for a in ("--baskets", "--product-category", "--categories", "--table", "--checkpoint"):
        st.add_argument(a, required=True)
    st.add_argument("--max-files", type=int)
    st.add_argument("--marts", help="refresh the KPI marts after a drain, or every ten minutes of a running stream")
    st.add_argument("--continuous", action="store_true", help="keep running instead of draining once")
    st.add_argument("--max-restarts", type=int, default=3, help="restarts from the checkpoint after a failure")

    w = sub.add_parser("watch", help="keep the table in step with files that are added, rewritten and deleted")
    for a in ("--baskets", "--product-category", "--categories", "--table", "--checkpoint"):
        w.add_argument(a, required=True)
    w.add_argument("--interval", default="30 seconds")
    w.add_argument("--origin")
    w.add_argument("--marts")

    status = sub.add_parser("status", help="the newest runs of a table, and whether its marts are stale")
    status.add_argument("--table", required=True)
    status.add_argument("--marts")
    status.add_argument("--last", type=int, default=20)
    return p


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    try:
        return _run(args, SparkSession.builder.appName(f"basketry-{args.cmd}").getOrCreate())
    except Exception as error:
        print(json.dumps({"failed": args.cmd, "error": f"{type(error).__name__}: {error}"[:2000]}))
        return 1


def _run(args: argparse.Namespace, spark: SparkSession) -> int:
    if args.cmd == "etl":
        from basketry.plans.etl_job import run_etl

        r = run_etl(spark, args.baskets, args.product_category, args.categories, args.table,
                    args.force, args.rejects, args.origin, args.takeover)
        done = {"ingested": r.ingested, "removed": r.removed, "skipped": r.skipped, "metrics": r.metrics, "version": r.version}
        if args.partials:
            from basketry.plans.partials import refresh_partials

            done["folded"] = refresh_partials(spark, args.table, args.partials, args.takeover)
        if args.marts:
            from basketry.plans.kpi_job import refresh_marts

            done["marts"] = refresh_marts(spark, args.table, args.marts, args.partials, takeover=args.takeover)
        print(json.dumps(done))
    elif args.cmd == "kpis":
        from basketry.plans.kpi_job import run_kpis
        from basketry.sources.parquet import read_enriched

        if args.partials:
            from basketry.plans.partials import run_kpis_from_partials

            names = run_kpis_from_partials(spark, args.partials, args.marts, args.parallelism, args.format)
        elif args.table:
            branches = [int(b) for b in args.branches.split(",")] if args.branches else None
            names = run_kpis(read_enriched(spark, args.table, branches), args.marts, args.parallelism, args.format)
        else:
            raise SystemExit("kpis needs --table or --partials")
        print(json.dumps({"marts": names}))
    elif args.cmd == "watch":
        from basketry.streaming.ingest import watch_sources

        watch_sources(
            spark, args.baskets, args.product_category, args.categories, args.table, args.checkpoint, args.interval,
            args.origin, args.marts,
        ).awaitTermination()
    elif args.cmd == "status":
        from basketry.operators.jobs import recent_n
        from basketry.sources.runlog import runs

        newest = recent_n(runs(spark, args.table), "seq", args.last)
        done = {"runs": [r.asDict() | {"at": str(r["at"]), "detail": json.loads(r["detail"])} for r in newest.collect()]}
        if args.marts:
            from basketry.plans.kpi_job import mart_status

            m = mart_status(spark, args.marts, args.table)
            done["marts"] = {"shown": m.shown, "newest": m.newest, "stale": m.stale, "last_event": m.last_event, "error": m.error}
        print(json.dumps(done))
    else:
        from pyspark.errors import StreamingQueryException

        from basketry.sources.csv import read_categories, read_product_category
        from basketry.streaming.ingest import ingest_stream

        restarts = 0
        while True:
            try:
                q = ingest_stream(
                    spark, args.baskets, read_product_category(spark, args.product_category),
                    read_categories(spark, args.categories), args.table, args.checkpoint,
                    max_files_per_trigger=args.max_files, available_now=not args.continuous,
                    marts_root=args.marts,
                )
                if args.continuous:
                    q.awaitTermination()
                break
            except StreamingQueryException as exc:
                # a failed micro-batch is replayed from the checkpoint on restart
                restarts += 1
                print(json.dumps({"stream_failed": str(exc)[:500], "restart": restarts}), file=sys.stderr)
                if restarts > args.max_restarts:
                    return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
