"""Reload of changed files: what a refresh reads, what readers see, what a failed refresh leaves."""

import os
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from provena.sources import snapshots as N


def _write(folder, name, rows, header="a,b", age=0):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as f:
        f.write("\n".join([header, *rows]) + "\n")
    os.utime(f"{folder}/{name}", (time.time() - age,) * 2)


def _states(df):
    return {os.path.basename(r.file): r.state for r in df.collect()}


def _seen(spark, store):
    return sorted((r.a, r.b, os.path.basename(r._file), r._version) for r in N.current(spark, store).collect())


def test_refresh_reads_new_and_changed_files_only(spark):
    d = tempfile.mkdtemp(prefix="provena-snap-", dir="/tmp")
    land, store = f"{d}/land", f"{d}/store"
    for i, name in enumerate(["one.csv", "two.csv", "three with space.csv"]):
        _write(land, name, [f"{i},x"], age=100)
    assert set(_states(N.refresh(spark, land, store, "csv")).values()) == {"new"}
    assert len(_seen(spark, store)) == 3
    assert set(_states(N.refresh(spark, land, store, "csv")).values()) == {"same"}
    assert N.loaded_files(spark, store)[0] == 1  # nothing changed: no new version
    _write(land, "two.csv", ["1,y", "7,z"], age=50)
    _write(f"{land}/sub", "four.csv", ["9,q"])
    os.remove(f"{land}/one.csv")
    read = []
    states = _states(N.refresh(spark, land, store, "csv", prepare=lambda df: (read.extend(
        os.path.basename(r.f) for r in df.select(F.input_file_name().alias("f")).distinct().collect()), df)[1]))
    assert states == {"one.csv": "removed", "two.csv": "changed", "three%20with%20space.csv": "same", "four.csv": "new"}
    assert sorted(read) == ["four.csv", "two.csv"]  # the scan saw no other file
    assert _seen(spark, store) == [("1", "y", "two.csv", 2), ("2", "x", "three%20with%20space.csv", 1), ("7", "z", "two.csv", 2), ("9", "q", "four.csv", 2)]


def test_failed_refresh_changes_nothing(spark):
    d = tempfile.mkdtemp(prefix="provena-snap-", dir="/tmp")
    land, store = f"{d}/land", f"{d}/store"
    _write(land, "one.csv", ["1,x"], age=100)
    N.refresh(spark, land, store, "csv")
    before = _seen(spark, store)
    _write(land, "one.csv", ["2,y"])
    with pytest.raises(Exception, match="lost"):
        N.refresh(spark, land, store, "csv", prepare=lambda df: df.withColumn("b", F.when(F.col("a") == "2", F.raise_error(F.lit("lost"))).otherwise(F.col("b"))))
    assert _seen(spark, store) == before and N.loaded_files(spark, store)[0] == 1
    N.refresh(spark, land, store, "csv")
    assert [r[:2] for r in _seen(spark, store)] == [("2", "y")]


def test_columns_may_come_and_go(spark):
    d = tempfile.mkdtemp(prefix="provena-snap-", dir="/tmp")
    land, store = f"{d}/land", f"{d}/store"
    _write(land, "one.csv", ["1,x"])
    N.refresh(spark, land, store, "csv")
    _write(land, "two.csv", ["2,y,z"], header="a,b,c")
    N.refresh(spark, land, store, "csv")
    assert sorted((r.a, r.c) for r in N.current(spark, store).collect()) == [("1", None), ("2", "z")]
