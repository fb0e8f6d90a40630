"""Source manifests and change detection.

A manifest is a DataFrame listing the input files (path, size, modification
time) built with the ``binaryFile`` source; the file contents are never read
because only metadata columns are selected.  Branch-level fingerprints are
order-independent aggregates, so no list of files is ever gathered into one
row.

A file is known by its source (``origin``) and its path below the source's root,
so a folder that is moved or mounted elsewhere under the same name has not changed.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A branch is named either by its folder (branch=<id>/...) or by its file (<id>_Tran.csv).
_BRANCH_FOLDER = r"branch=(\d+)/"
_BRANCH_FILE = r"(?:^|/)(\d+)_Tran\.csv$"
#: ASCII characters that a file's URI holds percent-encoded.
_ENCODED = re.compile(r'[\x00-\x20"<>\\^`{|}%\[\]#?]')


def source_root(path: str) -> str:
    """The folder of ``path`` without scheme and host, up to the first folder with a glob character, as in a file's URI."""
    bare = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", path)
    folders = re.sub(r"/+", "/", bare).rstrip("/").split("/")
    plain = next((i for i, f in enumerate(folders) if re.search(r"(?<!\\)[*?\[{]", f)), len(folders))
    kept = re.sub(r"\\(.)", r"\1", "/".join(folders[:plain])) + "/"
    return _ENCODED.sub(lambda c: f"%{ord(c.group()):02X}", kept)


def relative_file(uri: Column, root: str) -> Column:
    """The part of a file's URI below :func:`source_root`; all of it if it lies elsewhere."""
    at = F.instr(uri, root)
    return F.when(at > 0, F.substring(uri, at + len(root), F.length(uri))).otherwise(uri)


def slice_of(uri: Column, root: str, origin: str) -> Column:
    """The slice of the table that a file fills: a hash of its source and of its path below the source's root."""
    return F.xxhash64(F.lit(origin), relative_file(uri, root))


def fingerprint(file: Column, size: Column, mtime: Column) -> Column:
    """Changes with the file's path below the root, its size or its modification time."""
    return F.sha2(F.concat_ws("|", file, size.cast("string"), F.unix_micros(mtime).cast("string")), 256)


def branch_of(file: Column) -> Column:
    """The branch that a file's path names, or null."""
    found = [F.nullif(F.regexp_extract(file, p, 1), F.lit("")) for p in (_BRANCH_FOLDER, _BRANCH_FILE)]
    return F.coalesce(*found).try_cast("int")


def source_manifest(spark: SparkSession, path: str, pattern: str = "*.csv", origin: str | None = None) -> DataFrame:
    """One row per input file: file, branch, size, mtime, fingerprint, slice, uri.

    ``file`` is the path below the source's root; ``origin`` names the source (default: its root).
    """
    root = source_root(path)
    uri = F.col("_metadata.file_path")
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .load(path)
        .select(uri.alias("uri"), relative_file(uri, root).alias("file"), "length", "modificationTime")
    )
    return files.select(
        "file",
        branch_of(F.col("file")).alias("branch"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("mtime"),
        fingerprint(F.col("file"), F.col("length"), F.col("modificationTime")).alias("fingerprint"),
        slice_of(F.col("uri"), root, origin or root).alias("slice"),
        "uri",
    )


def branch_manifest(manifest: DataFrame) -> DataFrame:
    """Per branch: file count, total size, newest mtime and a combined fingerprint.

    The fingerprint combines the per-file hashes with two order-independent
    aggregates (count and a 64-bit wrapping sum of xxhash64), so adding,
    removing or touching any file of the branch changes it.
    """
    return manifest.groupBy("branch").agg(
        F.count("*").alias("n_files"),
        F.sum("size").alias("size"),
        F.max("mtime").alias("mtime"),
        F.sha2(
            F.concat_ws(
                "|",
                F.count("*").cast("string"),
                F.sum(F.xxhash64("fingerprint").cast("decimal(38,0)")).cast("string"),
            ),
            256,
        ).alias("fingerprint"),
    )


def manifest_diff(old: DataFrame, new: DataFrame, key: str = "branch", keep: str | None = None) -> DataFrame:
    """Full outer join of two manifests on ``key`` -> change kind per key (and the column ``keep``, the new one's first).

    ``added`` (only in new), ``removed`` (only in old), ``modified``
    (fingerprints differ), ``unchanged``.
    """
    o = old.select(F.col(key), F.col("fingerprint").alias("old_fingerprint"), *([F.col(keep).alias("__old")] if keep else []))
    n = new.select(F.col(key), F.col("fingerprint").alias("new_fingerprint"), *([F.col(keep).alias("__new")] if keep else []))
    change = (
        F.when(F.col("old_fingerprint").isNull(), F.lit("added"))
        .when(F.col("new_fingerprint").isNull(), F.lit("removed"))
        .when(F.col("old_fingerprint") != F.col("new_fingerprint"), F.lit("modified"))
        .otherwise(F.lit("unchanged"))
    )
    kept = [F.coalesce("__new", "__old").alias(keep)] if keep else []
    return o.join(n, key, "full_outer").select(key, change.alias("change"), "old_fingerprint", "new_fingerprint", *kept)


def table_fingerprint(manifest: DataFrame) -> DataFrame:
    """One-row fingerprint of a whole manifest (the re-run decision input)."""
    return manifest.agg(
        F.count("*").alias("n_files"),
        F.sha2(
            F.concat_ws(
                "|",
                F.count("*").cast("string"),
                F.sum(F.xxhash64("fingerprint").cast("decimal(38,0)")).cast("string"),
            ),
            256,
        ).alias("fingerprint"),
    )
