"""File sources and sinks: CSV in → cleaned parquet out, snapshots, cache merge."""

import os
import tempfile
import time

from pyspark.sql import functions as F

from provena.operators import geocode, referrals as R
from provena.sources import io
from tests.test_fixtures import raw_f1


def _tmp():
    return tempfile.mkdtemp(prefix="provena-io-", dir="/tmp")


def test_csv_in_parquet_out(spark):
    d = _tmp()
    raw = raw_f1(spark)
    # headers with stray spaces, as exported
    raw.toDF(*[f" {c} " for c in raw.columns]).coalesce(1).write.option("header", True).csv(f"{d}/in")
    loaded = io.load_table(spark, f"{d}/in", "csv")
    assert "Project ID" in loaded.columns and "_seq" in loaded.columns
    out = R.process_referrals(loaded)
    io.write_referrals(out, f"{d}/out")
    io.write_referrals(out, f"{d}/out")  # stale output replaced, not appended
    assert io.read_referrals(spark, f"{d}/out", "inbound").count() == 3
    assert io.read_referrals(spark, f"{d}/out", "outbound").count() == 2
    assert io.read_referrals(spark, f"{d}/out").count() == 5
    assert sorted(os.listdir(f"{d}/out"))[-2:] == ["referral_type=inbound", "referral_type=outbound"]


def test_provider_table_loader(spark):
    d = _tmp()
    df = spark.createDataFrame([("A", "1 Main", "Town", "MD", "20746", "12", "x"), ("B", None, "nan", None, None, "bad", "y")],
                               "`Full Name` string, Street string, City string, State string, Zip string, "
                               "`Referral Count` string, Preference string")
    df.coalesce(1).write.option("header", True).csv(f"{d}/p")
    got = {r["Full Name"]: r for r in io.load_provider_table(spark, f"{d}/p", "csv").collect()}
    assert got["A"]["Full Address"] == "1 Main, Town, MD 20746"
    assert got["B"]["Referral Count"] is None and "Preference" not in got["A"].asDict()


def test_latest_snapshot_and_signature(spark):
    d = _tmp()
    for i, name in enumerate(["old.csv", "new.csv"]):
        with open(f"{d}/{name}", "w") as f:
            f.write("a\n1\n")
        os.utime(f"{d}/{name}", (time.time() - 100 + 50 * i,) * 2)
    with open(f"{d}/notes.txt", "w") as f:
        f.write("ignored")
    latest = io.latest_snapshot_path(spark, d).first()["path"]
    assert latest.endswith("new.csv")
    sig = io.snapshot_signature(spark, d).first()["signature"]
    assert sig.count("|") == 1 and "new.csv" in sig and "notes.txt" not in sig


def test_merge_cache_newest_wins(spark):
    old = spark.createDataFrame([("k1", None, None, False, "2024-01-01 00:00:00"), ("k2", 1.0, 2.0, True, "2024-01-01 00:00:00")],
                                "addr_key string, latitude double, longitude double, found boolean, looked_up_at string")
    new = spark.createDataFrame([("k1", 3.0, 4.0, True, "2024-02-01 00:00:00")],
                                "addr_key string, latitude double, longitude double, found boolean, looked_up_at string")
    merged = {r["addr_key"]: r for r in geocode.merge_cache(old, new).collect()}
    assert merged["k1"]["found"] and merged["k1"]["latitude"] == 3.0 and merged["k2"]["found"]
