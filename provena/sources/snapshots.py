"""Reloading only what changed (A3/A4): a table kept in step with a folder of files.

The store has two parts.  ``files`` is a versioned table of the folder as it was loaded: a row per file with
its size, modification time and signature.  ``rows`` holds the loaded rows, partitioned by the signature of
the file they came from.  A refresh lists the folder (no contents read), compares the listing with the last
version and reads only files that are new or changed.  Their rows go into partitions of their own signature,
so nothing that readers see is touched; writing the new version of ``files``, a single file, is the switch.
A refresh that fails before it changes nothing, and the next one does its work again.

Rows of replaced or removed files stay in partitions that no version names; they can be dropped at leisure.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.session import cut_lineage
from provena.sources import io
from provena.sources.keyed import overwrite_partitions, path_exists

NEW, CHANGED, REMOVED, SAME = "new", "changed", "removed", "same"
FILES_SCHEMA = "file string, path string, size long, modified timestamp, signature string"


def list_signatures(spark: SparkSession, folder: str) -> DataFrame:
    """The folder's data files with a signature of path, size and modification time."""
    files = io.list_files(spark, folder, extra=("_metadata.file_path", "_metadata.file_size"))
    return files.select(
        F.col("file_path").alias("file"), "path", F.col("file_size").alias("size"), F.col("modificationTime").alias("modified"),
        F.md5(F.concat_ws("|", "file_path", F.col("file_size").cast("string"), F.unix_micros("modificationTime").cast("string"))).alias("signature"))


def _versions(spark: SparkSession, store: str) -> DataFrame | None:
    path = f"{store}/files"
    return spark.read.schema(f"{FILES_SCHEMA}, version int").parquet(path) if path_exists(spark, path) else None


def loaded_files(spark: SparkSession, store: str) -> tuple[int, DataFrame]:
    """The last version's number (0: none yet) and its files."""
    every = _versions(spark, store)
    last = every.agg(F.max("version")).first()[0] if every is not None else None
    if last is None:
        return 0, spark.createDataFrame([], FILES_SCHEMA)
    return last, every.filter(F.col("version") == last).drop("version")


def compare(listing: DataFrame, loaded: DataFrame) -> DataFrame:
    """``(file, path, signature, state)`` of every file that is there or was loaded."""
    now, before = listing.alias("n"), loaded.alias("b")
    state = (F.when(F.col("b.file").isNull(), NEW).when(F.col("n.file").isNull(), REMOVED)
             .when(F.col("n.signature") != F.col("b.signature"), CHANGED).otherwise(SAME))
    return now.join(before, F.col("n.file") == F.col("b.file"), "full").select(
        F.coalesce("n.file", "b.file").alias("file"), F.coalesce("n.path", "b.path").alias("path"),
        F.coalesce("n.signature", "b.signature").alias("signature"), state.alias("state"))


def refresh(spark: SparkSession, folder: str, store: str, fmt: str = "parquet",
            prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Bring ``store`` in step with ``folder``; what it found, as ``compare`` gives it.

    New and changed files are read (``io.load_table``), prepared row by row by ``prepare`` if given, and stored
    with ``_file``, the file they came from, and ``_version``, the refresh that read them.  The names of
    the files to read pass through the driver, as in any read.
    """
    listing = cut_lineage(list_signatures(spark, folder))
    version, loaded = loaded_files(spark, store)
    found = cut_lineage(compare(listing, loaded))
    todo = [r.path for r in found.filter(F.col("state").isin(NEW, CHANGED)).select("path").collect()]
    if todo:
        rows = io.load_table(spark, todo, fmt, file_col="_file")
        rows = prepare(rows) if prepare else rows
        signed = rows.join(listing.select(F.col("file").alias("_file"), "signature"), "_file")
        overwrite_partitions(signed.withColumn("_version", F.lit(version + 1)), f"{store}/rows", ["signature"])
    if version == 0 or not found.filter(F.col("state") != SAME).isEmpty():
        overwrite_partitions(listing.coalesce(1).withColumn("version", F.lit(version + 1)), f"{store}/files", ["version"])
    return found


def current(spark: SparkSession, store: str) -> DataFrame:
    """The rows of the last version's files (columns of all files; absent ones null)."""
    _, files = loaded_files(spark, store)
    rows = spark.read.option("mergeSchema", "true").parquet(f"{store}/rows")
    return rows.join(files.select("signature"), "signature", "left_semi").drop("signature")
