"""SparkSession construction and shared-storage helpers.

Everything runs with AQE on (runtime coalescing, skew-join splitting and
broadcast decisions made from *measured* shuffle sizes), ANSI mode on and
the session time zone pinned to UTC so that naive timestamps compare the
same way on every executor.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every session gets.  Broadcast joins are left to Spark's own
# size checks: the static threshold (10 MB plan estimate) and AQE's
# runtime threshold, which is measured on the materialised shuffle stage.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32m",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.parquet.inferTimestampNTZ.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "provena", extra: dict | None = None) -> SparkSession:
    """Return a session configured for this engine.

    ``master`` / ``shuffle_partitions`` are only meant for local runs and
    tests; on a cluster they come from spark-submit.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder is configured by the deployment and must be on
    shared storage; it is an error there if it is not.  Only a local master,
    whose executors are this process, gets a private scratch folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="provena-ckpt-", dir=os.environ.get("PROVENA_SCRATCH", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    try:  # classic sessions also register it for RDD checkpoints
        spark.sparkContext.setCheckpointDir(d)
    except Exception:  # e.g. a Spark Connect session has no SparkContext
        pass
    return d


def application_id(spark: SparkSession) -> str:
    """The running application's id (works for classic and Connect sessions)."""
    return spark.conf.get("spark.app.id", None) or spark.sparkContext.applicationId


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the plans that run inside; those of before come back."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def let_go(spark: SparkSession) -> None:
    """What Spark keeps on disk for plans that nobody holds any more goes now, not when the driver's JVM happens to collect
    its garbage.  For plans that no setting reaches, such as a stream's batches."""
    gc.collect()
    try:
        spark.sparkContext._jvm.System.gc()
    except Exception:  # e.g. a Spark Connect session, whose server does this by itself
        pass


#: A write's shuffle files go when it ends, not when the driver's JVM happens to collect its garbage.
DROP_SHUFFLES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


#: How intermediate tables and exports are written: a dictionary may grow to 16 MB (1 MB is full at 25,000 addresses, and every cell is then stored whole).
COMPACT = {"compression": "zstd", "parquet.dictionary.page.size": str(16 << 20)}


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once as a parquet table in the shared checkpoint folder.

    Used where one expensive intermediate is read by several branches of a
    job.  The table lives on the shared storage named by
    ``spark.checkpoint.dir`` (never a machine-local folder, never a local
    checkpoint), so it survives executor loss; reading it back gives
    column pruning and predicate pushdown to every consumer.  A written
    table costs one computation, whereas an un-persisted RDD checkpoint
    would compute the plan twice.
    """
    spark = df.sparkSession
    app = application_id(spark)
    # Namespaced per application so a finished application's tables can be
    # removed as a whole by the folder's retention policy.
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{app}/{uuid.uuid4().hex}"
    with settings(spark, DROP_SHUFFLES):
        df.write.mode("overwrite").options(**COMPACT).parquet(path)
    # Known schema: no footer-inference job on the way back.
    return spark.read.schema(df.schema).parquet(path)
