"""Keyed tables and the stored geocode cache: what an upsert touches, what a failed one leaves, replays."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from provena.operators import geocode
from provena.sources import keyed
from provena.sources.keyed import read_keyed, upsert

SCHEMA = "k string, v long, part string"


def _dir():
    return tempfile.mkdtemp(prefix="provena-keyed-", dir="/tmp")


def _files(path):
    return {p: sorted(f for f in os.listdir(f"{path}/{p}") if f.endswith(".parquet")) for p in os.listdir(path) if "=" in p}


def _rows(spark, path, schema=SCHEMA):
    from pyspark.sql import types as T
    return sorted(map(tuple, read_keyed(spark, path, T.StructType.fromDDL(schema)).select("k", "v").collect()), key=str)


def test_upsert_rewrites_touched_partitions_only(spark):
    t = f"{_dir()}/t"
    upsert(t, spark.createDataFrame([("a", 1, "07"), ("b", 2, "07"), ("c", 3, "1e2"), (None, 4, "x")], SCHEMA), ["k"], "part")
    before = _files(t)
    upsert(t, spark.createDataFrame([("b", 9, "07"), ("d", 5, "08"), (None, 6, "x")], SCHEMA), ["k"], "part")
    after = _files(t)
    assert after["part=1e2"] == before["part=1e2"] and after["part=07"] != before["part=07"]
    assert _rows(spark, t) == sorted([("a", 1), ("b", 9), ("c", 3), ("d", 5), (None, 6)], key=str)
    upsert(t, spark.createDataFrame([], SCHEMA), ["k"], "part")
    assert _files(t) == after
    assert {r.part for r in read_keyed(spark, t, spark.createDataFrame([], SCHEMA).schema).collect()} == {"07", "08", "1e2", "x"}


def test_order_decides_between_old_and_new(spark):
    t = f"{_dir()}/t"
    smallest = [F.col("v").asc_nulls_last()]
    for rows in ([("a", 5, "p"), ("b", 5, "p")], [("a", 7, "p"), ("b", 3, "p")]):
        upsert(t, spark.createDataFrame(rows, SCHEMA), ["k"], "part", smallest)
    assert _rows(spark, t) == [("a", 5), ("b", 3)]


def test_crashed_upsert_changes_nothing(spark, monkeypatch):
    t = f"{_dir()}/t"
    upsert(t, spark.createDataFrame([("a", 1, "p"), ("b", 2, "q")], SCHEMA), ["k"], "part")
    before = _files(t)
    bad = spark.createDataFrame([("a", 9, "p"), ("z", 9, "q")], SCHEMA).withColumn(
        "v", F.when(F.col("k") == "z", F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        upsert(t, bad, ["k"], "part")
    assert _files(t) == before

    def stopped(*_):
        raise RuntimeError("stopped before the switch")

    monkeypatch.setattr(keyed, "overwrite_partitions", stopped)
    with pytest.raises(RuntimeError):
        upsert(t, spark.createDataFrame([("a", 9, "p")], SCHEMA), ["k"], "part")
    assert _files(t) == before and _rows(spark, t) == [("a", 1), ("b", 2)]


def _entries(spark, rows):
    return spark.createDataFrame(rows, "address string, latitude double, longitude double, looked_up_at string").withColumn(
        "looked_up_at", F.col("looked_up_at").cast("timestamp_ntz"))


def test_cache_keeps_the_newest_per_key(spark):
    path = f"{_dir()}/cache"
    assert geocode.read_cache(spark, path).count() == 0
    many = [(f"{i} Main Street", 1.0, 2.0, "2024-01-01 00:00:00") for i in range(300)]
    geocode.update_cache(path, geocode.cache_entries(_entries(spark, [*many, (None, 1.0, 2.0, "2024-01-01 00:00:00")])))
    before = _files(path)
    answers = [("1 Main Street", 5.0, 6.0, "2024-02-01 00:00:00"), ("2 main street ", None, None, "2024-02-01 00:00:00"),
               ("3 Main Street", 9.0, 9.0, "2023-01-01 00:00:00"), ("new place 1", None, 3.0, "2024-02-01 00:00:00")]
    for _ in range(2):  # a replay changes nothing more
        geocode.update_cache(path, geocode.cache_entries(_entries(spark, answers)))
    got = {r.address: r for r in geocode.read_cache(spark, path).collect()}
    assert len(got) == 301 and got["1 Main Street"].latitude == 5.0 and got["3 Main Street"].latitude == 1.0
    assert not got["2 main street "].found and "2 Main Street" not in got and not got["new place 1"].found
    after = _files(path)
    touched = {p for p in after if after[p] != before.get(p)}
    assert 2 <= len(touched) <= 4 and set(after) - touched == set(before) - touched


def test_run_saves_its_tables(spark):
    contacts = spark.createDataFrame(
        [("A", "1", "1 Main St Ste 5", None, None), ("A", "1", "1 Main St Ste 5", None, None), ("B", "2", "2 Oak Avenue #9", None, None),
         ("C", "3", "3 Elm Road Apt 7", None, 1.0), ("D", "4", "4 Fir Lane", 1.0, 2.0), ("E", "5", None, None, None)],
        "full_name string, person_id string, address string, latitude double, longitude double")
    cache = geocode.cache_entries(_entries(spark, [("1 Main St Ste 5", 10.0, 20.0, "2024-01-01 00:00:00"),
                                                   ("2 Oak Avenue #9", None, None, "2024-01-01 00:00:00"), ("2 Oak Avenue 9", 30.0, 40.0, "2024-01-01 00:00:00")]))
    paths = geocode.GeocodeRun(contacts, cache).write(_dir())
    table = {n: sorted(map(tuple, spark.read.parquet(p).collect()), key=str) for n, p in paths.items()}
    assert table["geocoded"] == [("A", "1", 10.0, 20.0), ("B", "2", 30.0, 40.0)]
    assert table["failures"] == [("B", "2 Oak Avenue #9"), ("C", "3 Elm Road Apt 7")]
    assert table["work_list"] == [("3 Elm Road Apt 7",)] and len(table["all_results"]) == 3
