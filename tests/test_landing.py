"""Derived exports as files: their size with many parties, and who writes a reload's parts."""

import glob
import os
import tempfile

from pyspark.sql import functions as F

from provena.plans import queries as Q
from provena.session import cut_lineage
from provena.sources import io, keyed
from provena.sources import testdata as td

SF = "/root/testdata/sf0.001"


def _bytes(folder):
    return sum(os.path.getsize(f) for f in glob.glob(f"{folder}/*.parquet"))


def test_landed_texts_of_many_parties_stay_in_dictionaries(spark):
    d = tempfile.mkdtemp(prefix="provena-land-", dir="/tmp")
    key = F.pmod(F.xxhash64("id"), F.lit(60_000))
    rows = spark.range(0, 600_000, 1, 1).select(td._key_name(key).alias("name"), td.key_address(key).alias("address"))
    rows.write.parquet(f"{d}/plain")
    landed = td.landed(spark, d, "many_parties", lambda: rows)
    assert _bytes(landed.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]) < 0.4 * _bytes(f"{d}/plain")
    assert landed.exceptAll(rows).isEmpty() and landed.count() == 600_000


def test_reload_lands_each_part_from_several_tasks(spark, monkeypatch):
    d = tempfile.mkdtemp(prefix="provena-reload-", dir="/tmp")
    raw = td.raw_export(spark, SF).repartition(4)
    monkeypatch.setattr(Q.td, "raw_export", lambda *_: raw)
    monkeypatch.setattr(Q, "_new_folder", lambda *_: f"{d}/base")
    rows = Q.reload_changed_files(spark, SF).collect()
    assert {(r.part, r.loaded_in) for r in rows} == {(p, 2 if p == 3 else 1) for p in range(8)}
    for part in range(8):
        assert len(glob.glob(f"{d}/base/landing/part={part}/*.parquet")) > 1
    replaced = F.pmod(F.col("_seq.l_orderkey"), F.lit(8)) == 3
    assert sum(r.row_count for r in rows) == raw.filter(~replaced | (F.col("_seq.l_linenumber") > 1)).count()


def test_no_text_of_a_party_is_shuffled(spark):
    """The export's joins move keys; texts are made above the last of them, where the rows are written."""
    plan = td.raw_referrals(spark, SF)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    joins = [i for i, line in enumerate(plan) if "Join " in line]
    assert len(joins) == 4 and not [line for line in plan[joins[0]:] if "Supplier#" in line or "Main St" in line]


def test_a_stored_table_leaves_no_shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: blocks.getAllFiles().mkString("\n").count("/shuffle_")
    before = files()
    kept = cut_lineage(spark.range(1000).groupBy((F.col("id") % 100).alias("k")).count())
    assert files() <= before and kept.count() == 100


def test_prepared_and_keyed_texts_stay_in_dictionaries(spark):
    d = tempfile.mkdtemp(prefix="provena-land-", dir="/tmp")
    key = F.pmod(F.xxhash64("id"), F.lit(60_000))
    rows = spark.range(0, 600_000, 1, 1).select(td._key_name(key).alias("full_name"), td.key_address(key).alias("address"),
                                                F.lit("a").alias("referral_type"), F.lit(1).alias("_seq"), F.lit(None).cast("timestamp_ntz").alias("date_of_intake"))
    rows.write.option("compression", "snappy").parquet(f"{d}/plain")
    io.write_referrals(rows.withColumn("date_of_intake", F.to_timestamp_ntz(F.date_add(F.lit("2024-01-01"), F.pmod(F.hash("full_name", "address"), F.lit(999)).cast("int")).cast("string"))), f"{d}/prepared")
    keyed.overwrite_partitions(rows, f"{d}/keyed", ["referral_type"])
    assert _bytes(f"{d}/prepared/referral_type=a") < 0.6 * _bytes(f"{d}/plain") and _bytes(f"{d}/keyed/referral_type=a") < 0.4 * _bytes(f"{d}/plain")
