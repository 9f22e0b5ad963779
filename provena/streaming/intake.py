"""Incremental referral intake with Structured Streaming.

* J1 — new export files in a folder → the row-local part of the ETL (split, predicates, cleaning) → appended
  to the referral table.  Stateless; the file source tracks what it has read in the checkpoint.
* J2 — the first row per Person ID and party, in two variants.  ``run_first_seen`` is exact: each micro-batch is
  reduced to its first row per key and upserted into a table bucketed by the key, so the result is that of the
  batch rule (E2) however the input is cut into batches.  ``run_first_seen_bounded`` keeps its keys in the state
  store for a time only (``dropDuplicatesWithinWatermark`` on RocksDB): an append stream of bounded state, that
  passes a repeat whose first row lies further back than the watermark.
* J3 — referrals per provider key and calendar month, as a running table: a stateful aggregation in update mode
  (RocksDB) gives the new totals of the groups that a batch has touched, and an upsert rewrites the months they
  fall into.  Open months are in the table from their first row on.

Every query uses ``trigger(availableNow=True)`` so it drains what is there and stops; run it again (e.g. on a
schedule) to pick up new files.  A batch that is replayed after a crash writes the same rows again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provena import schema as S
from provena.operators import referrals as R
from provena.operators.dedup import keep_first
from provena.session import COMPACT, let_go, settings
from provena.sources.keyed import hash_bucket, overwrite_partitions, path_exists, read_keyed, upsert

FILES_PER_TRIGGER = 64
#: Partitions of the exact first-seen table; an upsert rewrites those its keys fall into.
ID_BUCKETS = 64
#: What identifies a provider in the referral counts (as D2).
COUNT_KEYS = ["full_name", "work_address", "work_phone", "latitude", "longitude"]
#: The month of rows without an intake date.
UNDATED = "undated"
COUNT_SCHEMA = ("referral_type string, full_name string, work_address string, work_phone string, latitude double, "
                "longitude double, referrals long, month string")


#: State on executors' disks instead of their heaps, for queries started with these settings (a query keeps the store it started with).
ROCKSDB_STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
                 "spark.sql.streaming.stateStore.rocksdb.compression": "zstd"}


def referral_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    """Streaming read of export files (parquet, fixed schema) → cleaned long rows."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    if "_seq" not in schema.names:
        raw = raw.withColumn("_seq", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("pos")))
    return R.split_referrals(raw)


def run_intake(spark: SparkSession, folder: str, schema: T.StructType, target: str, checkpoint: str) -> None:
    """Append cleaned referral rows to ``target`` (parquet)."""
    q = (referral_stream(spark, folder, schema).drop("_cfg")
         .writeStream.format("parquet").options(**COMPACT).option("path", target).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()


# --- J2: first row per Person ID ------------------------------------------------
def run_first_seen(spark: SparkSession, folder: str, schema: T.StructType, target: str, checkpoint: str,
                   files_per_trigger: int = FILES_PER_TRIGGER) -> None:
    """J2, exact: the first row by ``_seq`` per (party, Person ID), over all batches ever drained.

    Rows with an ID are kept in ``target/with_id``, one per key.  Rows without one go to ``target/without_id``, a
    partition per batch, because whether they collapse depends on whether their party ever brings an ID (E2).
    Exports without a ``_seq`` of their own are ordered by batch, then by place in it.
    """
    order = ["_seq"] if "_seq" in schema.names else ["_batch", "_seq"]

    def merge(batch: DataFrame, epoch: int) -> None:
        rows = batch.withColumn("_batch", F.lit(epoch).cast("long"))
        with_id = keep_first(rows.filter(F.col("person_id").isNotNull()), ["_cfg", "person_id"], order)
        upsert(f"{target}/with_id", with_id.withColumn("bucket", hash_bucket(["_cfg", "person_id"], ID_BUCKETS)),
               ["_cfg", "person_id"], "bucket", order)
        without_id = rows.filter(F.col("person_id").isNull())
        if not without_id.isEmpty():
            overwrite_partitions(without_id, f"{target}/without_id", ["_batch"])

    q = (referral_stream(spark, folder, schema, files_per_trigger).writeStream.foreachBatch(merge)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def read_first_seen(spark: SparkSession, target: str, mode: str = "reference") -> DataFrame:
    """The drained referrals under E2's rule for rows without an ID (``reference``, ``keep_null_ids``).

    Repeats of an ID are already gone, so the rule sees one row per key and the rows without one.
    """
    parts = [spark.read.parquet(p) for p in (f"{target}/with_id", f"{target}/without_id") if path_exists(spark, p)]
    if not parts:
        return spark.createDataFrame([], S.REFERRALS_SCHEMA)
    rows = [p.select(*S.REFERRAL_COLUMNS, "_cfg", "_seq") for p in parts]
    both = rows[0].unionByName(rows[1]) if len(rows) == 2 else rows[0]
    return R.dedup_person_ids(both, mode=mode).select(*S.REFERRAL_COLUMNS)


def run_first_seen_bounded(spark: SparkSession, folder: str, schema: T.StructType, target: str, checkpoint: str,
                           watermark: str = "90 days", files_per_trigger: int = FILES_PER_TRIGGER) -> None:
    """J2 with bounded state: rows whose (party, Person ID) is not in the state store, appended to ``target``.

    A key stays in the store until the watermark (the latest intake date less ``watermark``) passes its intake date plus
    ``watermark``; a repeat after that is passed again, and a row that arrives behind the watermark is dropped.  Rows
    without an ID are all passed (E2's ``keep_null_ids``), once for each ``_seq``.  A row without an intake date counts as
    of its arrival.
    """
    rows = referral_stream(spark, folder, schema, files_per_trigger)
    # No ID: the row's place is its key, as it is; as text it would be the largest part of the state.
    keyed = rows.withColumns({"_own": F.when(F.col("person_id").isNull(), F.col("_seq")),
                              "_at": F.coalesce(F.col("date_of_intake").cast("timestamp"), F.current_timestamp())})
    firsts = keyed.withWatermark("_at", watermark).dropDuplicatesWithinWatermark(["_cfg", "person_id", "_own"]).drop("_own", "_at", "_cfg")
    with settings(spark, ROCKSDB_STATE):
        q = (firsts.writeStream.format("parquet").options(**COMPACT).option("path", target).option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    let_go(spark)


# --- J3: referrals per provider and month ---------------------------------------
def month_of(date: Column) -> Column:
    return F.coalesce(F.date_format(date, "yyyy-MM"), F.lit(UNDATED))


def running_counts(rows: DataFrame) -> DataFrame:
    """J3 over a stream or a table: referrals per party type, provider key and calendar month of the intake date.

    Rows with a null in the provider key are not counted (Q2), rows without a date count as ``undated``; so the months
    of a window add up to D2's counts in it.
    """
    whole = rows.dropna(subset=COUNT_KEYS)
    return whole.groupBy("referral_type", *COUNT_KEYS, month_of(F.col("date_of_intake")).alias("month")).agg(
        F.count(F.lit(1)).alias("referrals"))


def run_running_counts(spark: SparkSession, folder: str, schema: T.StructType, target: str, checkpoint: str,
                       files_per_trigger: int = FILES_PER_TRIGGER) -> None:
    """Drain new files into the monthly count table ``target`` (read it with ``read_running_counts``).

    There is no watermark: a row counts in its month however late it comes, and the month is rewritten then.  The price
    is one state entry per group, on disk.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        upsert(target, batch.select("referral_type", *COUNT_KEYS, "referrals", "month"), ["referral_type", *COUNT_KEYS, "month"], "month")

    with settings(spark, ROCKSDB_STATE):
        q = (running_counts(referral_stream(spark, folder, schema, files_per_trigger)).writeStream.outputMode("update").foreachBatch(merge)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    let_go(spark)


def read_running_counts(spark: SparkSession, target: str) -> DataFrame:
    return read_keyed(spark, target, T.StructType.fromDDL(COUNT_SCHEMA))
