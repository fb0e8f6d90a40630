"""Delimited-text scans of the branch receipt files and the two dimensions.

Bad lines never fail a job: files are read PERMISSIVE with a corrupt-record
column, and accepted and rejected lines are two views of the same scan.  CSV
column pruning is switched off by a read option because with pruning the set
of "malformed" lines depends on which columns a query happens to read (a line
with an extra field is accepted by a two-column query and rejected by a
four-column one).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql.streaming import DataStreamReader
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from basketry.schemas import (
    LOTE_COLUMN,
    CATEGORY_SCHEMA,
    CORRUPT_COLUMN,
    PRODUCT_CATEGORY_SCHEMA,
    RAW_BASKET_SCHEMA,
    with_corrupt_column,
)
from basketry.sources.manifest import slice_of, source_root

SEPARATOR = "|"
# Fixed value: header line of the product -> category file (ignored on read, mapped by position).
PRODUCT_CATEGORY_HEADER = ["v.Code_pr", "v.code"]


def _options(header: bool, pattern: str) -> dict[str, str]:
    return {
        "sep": SEPARATOR,
        "header": str(header).lower(),
        "enforceSchema": "true",
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": CORRUPT_COLUMN,
        "pathGlobFilter": pattern,
        # every field of every line is parsed, whatever columns the query needs, or malformed lines would pass
        "columnPruning": "false",
    }


def _reader(spark: SparkSession, schema: StructType, header: bool, pattern: str) -> DataFrameReader:
    return (
        spark.read.schema(with_corrupt_column(schema))
        .options(**_options(header, pattern))
        .option("recursiveFileLookup", "true")
    )


def _accepted(required: list[str]) -> Column:
    cond = F.col(CORRUPT_COLUMN).isNull()
    for c in required:
        cond = cond & F.col(c).isNotNull()
    return cond


def scan_baskets(spark: SparkSession, path: str | list[str], pattern: str = "*.csv") -> DataFrame:
    """The raw scan: the four fields plus the corrupt-record column, every line."""
    return _reader(spark, RAW_BASKET_SCHEMA, False, pattern).csv(path)


ACCEPTED_BASKET = ["fecha", "sucursal_id", "cliente_id"]


def basket_accepted() -> Column:
    """True for a well-formed receipt line of :func:`scan_baskets`."""
    return _accepted(ACCEPTED_BASKET)


def rejected_baskets(raw: DataFrame) -> DataFrame:
    """Malformed lines of a raw scan, with the source file name (a column ``archivo`` if the scan has it) and slice."""
    name = F.col("archivo") if "archivo" in raw.columns else F.col("_metadata.file_name")
    extra = [LOTE_COLUMN] if LOTE_COLUMN in raw.columns else []
    return raw.filter(~basket_accepted()).select(
        name.alias("archivo"), *RAW_BASKET_SCHEMA.fieldNames(), CORRUPT_COLUMN, *extra
    )


def read_baskets(spark: SparkSession, path: str | list[str], pattern: str = "*.csv") -> DataFrame:
    """All branch files under ``path`` (one implicit union), well-formed lines only.

    A line is accepted when it has exactly four fields and date, branch and
    customer are present and parse; an empty basket is accepted (it yields no
    units later).
    """
    return accepted_baskets(scan_baskets(spark, path, pattern))


def accepted_baskets(raw: DataFrame) -> DataFrame:
    """Well-formed lines of a raw (batch or streaming) scan, with their slice if the scan has it."""
    extra = [LOTE_COLUMN] if LOTE_COLUMN in raw.columns else []
    return raw.filter(basket_accepted()).select(*RAW_BASKET_SCHEMA.fieldNames(), *extra)


def with_slice(raw: DataFrame, path: str, origin: str | None = None) -> DataFrame:
    """Each line of a scan of ``path`` with its file's slice of the table, see :mod:`basketry.sources.manifest`."""
    root = source_root(path)
    return raw.withColumn(LOTE_COLUMN, slice_of(F.col("_metadata.file_path"), root, origin or root))


def basket_stream_reader(spark: SparkSession, pattern: str = "*.csv") -> DataStreamReader:
    """Structured Streaming twin of the batch reader (same schema and options)."""
    return spark.readStream.schema(with_corrupt_column(RAW_BASKET_SCHEMA)).options(**_options(False, pattern))


def read_basket_rejects(spark: SparkSession, path: str | list[str], pattern: str = "*.csv") -> DataFrame:
    """The complement of :func:`read_baskets`, with the source file name."""
    return rejected_baskets(scan_baskets(spark, path, pattern))


def read_product_category(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    raw = _reader(spark, PRODUCT_CATEGORY_SCHEMA, True, pattern).csv(path)
    return raw.filter(_accepted(["producto_id", "categoria_id"])).select(
        *PRODUCT_CATEGORY_SCHEMA.fieldNames()
    )


def read_categories(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """Headerless category names; CRLF line ends are handled by the CSV reader."""
    raw = _reader(spark, CATEGORY_SCHEMA, False, pattern).csv(path)
    return raw.filter(_accepted(["categoria_id"])).select("categoria_id", "nombre_categoria")


def write_baskets(df: DataFrame, path: str) -> None:
    """Receipt lines in the branch file format, one folder per branch.

    The branch id stays inside every line (it is a field of the format); the
    folder ``branch=<id>`` only groups a branch's files.  ``rebalance`` keeps
    a large branch from landing in one task and small ones from making tiny files.
    """
    (
        df.select(*RAW_BASKET_SCHEMA.fieldNames())
        .withColumn("branch", F.col("sucursal_id"))
        .hint("rebalance", "branch")
        .write.mode("overwrite")
        .partitionBy("branch")
        .option("sep", SEPARATOR)
        .option("header", False)
        .csv(path)
    )


def write_product_category(df: DataFrame, path: str) -> None:
    (
        df.select(*PRODUCT_CATEGORY_SCHEMA.fieldNames())
        .toDF(*PRODUCT_CATEGORY_HEADER)
        .write.mode("overwrite")
        .option("sep", SEPARATOR)
        .option("header", True)
        .csv(path)
    )


def write_categories(df: DataFrame, path: str) -> None:
    (
        df.select(*CATEGORY_SCHEMA.fieldNames())
        .write.mode("overwrite")
        .option("sep", SEPARATOR)
        .option("header", False)
        .csv(path)
    )
