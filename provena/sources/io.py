"""Sources and sinks (A1–A10).

Readers return lazy DataFrames; writers use Spark's file commit protocol
(no temp-file-and-rename of our own).  Listing a folder for the newest
snapshot uses the ``binaryFile`` source with only ``path`` and
``modificationTime`` selected, so file contents are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provena.functions import text
from provena.session import COMPACT, DROP_SHUFFLES, settings

DATA_EXTENSIONS = ("csv", "parquet")
#: Snappy, with dictionaries as large as those of other tables.
SNAPPY = COMPACT | {"compression": "snappy"}


def strip_headers(df: DataFrame) -> DataFrame:
    """Trim whitespace around every column name (one ``toDF``)."""
    return df.toDF(*[c.strip() for c in df.columns])


def load_table(spark: SparkSession, path: str | list[str], fmt: str | None = None, add_seq: bool = True,
               file_col: str | None = None, corrupt_col: str | None = None) -> DataFrame:
    """A1: CSV (all columns as strings, header row) or Parquet, one path or several; headers trimmed.

    ``_seq`` records the input order (file, then position) for keep-first
    operators; it is taken directly on the scan, like ``file_col``, the file a row came from.
    ``corrupt_col`` keeps the text of CSV lines that don't fit the header
    (too few or too many cells) in a column of that name, null for sound
    lines; the cells such a line does have are kept.
    """
    paths = [path] if isinstance(path, str) else list(path)
    fmt = fmt or ("parquet" if all(p.rstrip("/").endswith(".parquet") for p in paths) else "csv")
    if fmt == "csv":
        reader = spark.read.option("header", True).option("inferSchema", False)
        df = reader.csv(paths)
        if corrupt_col:
            schema = T.StructType([*df.schema.fields, T.StructField(corrupt_col, T.StringType())])
            df = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt_col).schema(schema).csv(paths)
    elif fmt == "parquet":
        df = spark.read.parquet(*paths)
    else:
        raise ValueError(f"Unsupported file type: {fmt}")
    if file_col:
        df = df.withColumn(file_col, F.col("_metadata.file_path"))
    if add_seq and "_seq" not in df.columns:
        df = df.withColumn("_seq", F.struct(F.col("_metadata.file_path").alias("file"),
                                            F.monotonically_increasing_id().alias("pos")))
    return strip_headers(df)


def load_provider_table(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """A2: provider file → drop ``Preference``, blank-fill address parts,
    numeric ``Referral Count`` (bad → null), naive ``Full Address`` when absent."""
    df = load_table(spark, path, fmt).drop("Preference")
    parts = {c: text.text_or_blank(F.col(c)) for c in ("Street", "City", "State", "Zip") if c in df.columns}
    df = df.withColumns(parts) if parts else df
    if "Referral Count" in df.columns:
        df = df.withColumn("Referral Count", F.col("Referral Count").cast("string").try_cast("double"))
    if "Full Address" not in df.columns:
        def part(c):
            return F.col(c) if c in df.columns else F.lit("")
        df = df.withColumn("Full Address", text.naive_full_address(part("Street"), part("City"), part("State"), part("Zip")))
    return df


def list_files(spark: SparkSession, folder: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Data files under ``folder`` with their modification time (no contents read)."""
    pattern = "*.{" + ",".join(DATA_EXTENSIONS) + "}"
    return (spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
            .load(folder).select("path", "modificationTime", *extra))


def latest_snapshot_path(spark: SparkSession, folder: str) -> DataFrame:
    """A3: one row with the newest data file (ties broken by path)."""
    files = list_files(spark, folder)
    return files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"),
                     F.max("modificationTime").alias("modificationTime"))


def snapshot_signature(spark: SparkSession, folder: str) -> DataFrame:
    """A4: ``folder:file:epoch`` entries joined with ``|`` in path order; a change means reload."""
    files = list_files(spark, folder)
    entry = F.concat_ws(":", F.lit(folder), F.element_at(F.split("path", "/"), -1),
                        F.unix_timestamp("modificationTime").cast("string"))
    return files.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", entry.alias("e")))),
                                              lambda x: x["e"]), "|").alias("signature"))


def write_referrals(referrals: DataFrame, out_dir: str) -> None:
    """Snappy parquet partitioned by ``referral_type``; inbound / outbound are partition reads."""
    with settings(referrals.sparkSession, DROP_SHUFFLES):
        (referrals.drop("_seq")
         .sortWithinPartitions(F.asc_nulls_last("date_of_intake"), F.asc_nulls_last("full_name"))
         .write.mode("overwrite").options(**SNAPPY).partitionBy("referral_type").parquet(out_dir))


def write_clustered(referrals: DataFrame, out_dir: str, files: int | None = None) -> None:
    """A6 with F4's other layout: files cover boxes of latitude, longitude and date (``sources.layout``)."""
    from provena.sources.layout import z_ordered
    with settings(referrals.sparkSession, DROP_SHUFFLES):
        z_ordered(referrals.drop("_seq"), files=files).write.mode("overwrite").options(**SNAPPY).parquet(out_dir)


def read_referrals(spark: SparkSession, out_dir: str, referral_type: str | None = None) -> DataFrame:
    df = spark.read.parquet(out_dir)
    return df if referral_type is None else df.filter(F.col("referral_type") == referral_type)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Overwrite a parquet table, or a CSV with a header row."""
    w = df.drop("_seq").write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.options(**SNAPPY).parquet(path)
