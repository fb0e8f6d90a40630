"""Retail-basket analytics on Spark DataFrames.

Layout:
    sources/    scans and sinks (CSV ingest, partitioned Parquet, marts, manifests)
    functions/  Column-expression helpers (JVM-side, codegen friendly)
    operators/  DataFrame -> DataFrame building blocks (ETL, visits, KPIs, statistics)
    plans/      composed jobs (ETL job, KPI job) and the query catalog
    streaming/  Structured Streaming ingestion of new branch files
"""

__all__ = ["__version__"]
__version__ = "0.1.0"
