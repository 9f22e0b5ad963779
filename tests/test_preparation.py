"""Summary on the write, overlay with all columns, dataset dispatch, sources that fail, output orders."""

import os
import tempfile

from pyspark.sql import functions as F

from provena.functions import text
from provena.operators import overlay, preparation, quality, referrals as R, rollup
from provena.plans import datasets as D
from provena.sources import io
from tests.test_fixtures import raw_f1


def _dir():
    return tempfile.mkdtemp(prefix="provena-prep-", dir="/tmp")


def _summary(df):
    return {(r.section, r.name): r.value for r in df.collect()}


def test_summary_of_a_written_run(spark):
    out = f"{_dir()}/referrals"
    got = _summary(preparation.prepare(raw_f1(spark), out))
    assert got == {("rows", "inbound"): 3, ("rows", "outbound"): 2, ("rows", "all"): 5} | {k: v for k, v in got.items() if k[0] in ("issue", "warning")}
    assert io.read_referrals(spark, out).count() == 5
    issues = {k[1]: v for k, v in got.items() if k[0] == "issue"}
    long = R.process_referrals(raw_f1(spark))
    for column, reason in preparation.ISSUES:
        n = long.filter(quality._blankish(column)).count()
        assert issues.get(f"all: {reason}", 0) == n


def test_skipped_configs_and_warnings(spark):
    raw = raw_f1(spark)
    secondary = [c for c in raw.columns if c.startswith("Secondary")]
    got = _summary(preparation.prepare(raw.drop(*secondary, "Referred From's Work Phone"), f"{_dir()}/r"))
    assert ("skipped", "secondary_inbound") in got and got[("rows", "inbound")] == 2
    warned = [k[1] for k in got if k[0] == "warning"]
    assert any(w.startswith("primary_inbound missing columns: ") and "Referred From's Work Phone" in w for w in warned)
    assert not any("Person ID" in w for w in warned)  # optional headers don't warn
    empty = spark.createDataFrame([], "`Project ID` string, `Date of Intake` string")
    out = f"{_dir()}/r"
    got = _summary(preparation.prepare(empty, out))
    assert got[("rows", "all")] == 0 and {k[1] for k in got if k[0] == "skipped"} == {"primary_inbound", "secondary_inbound", "outbound"}


def test_overlay_keeps_other_columns(spark):
    raw = spark.createDataFrame(
        [("1", "2024-05-01", "Clinic", "555", "Dr. A", "777", "note 1", "1980-01-01"), ("2", "45500", None, None, "Dr. B", None, "note 2", "2024-01-01"),
         ("3", None, None, None, None, None, "note 3", None)],
        "`Project ID` string, `Create Date` string, `Referred To Full Name` string, `Referred To's Work Phone` string, `Referred From Full Name` string, "
        "`Referred From's Work Phone` string, Comment string, `Date of Intake` string")
    rows = [(r["Project ID"], r["referral_type"], r["Full Name"], r["Work Phone"], r["Comment"], str(r["Referral Date"])[:10], r["Latitude"])
            for r in overlay.overlay_all(raw).orderBy("Project ID", "_party").collect()]
    assert rows == [("1", "outbound", "Clinic", "555", "note 1", "2024-05-01", None), ("1", "inbound", "Dr. A", "777", "note 1", "2024-05-01", None),
                    ("2", "inbound", "Dr. B", None, "note 2", "2024-07-27", None)]
    assert overlay.overlay_all(raw).filter("`Date of Intake` < '1990-01-01'").count() == 0  # implausible dates are null
    one = overlay.overlay(raw, "inbound")
    assert one.count() == 3 and "Comment" in one.columns and {r["referral_type"] for r in one.collect()} == {"inbound"}
    bare = raw.drop("Referred To Full Name", "Referred From Full Name")
    assert overlay.overlay_all(bare).count() == 3 and "Full Name" not in overlay.overlay(bare, "inbound").columns
    own = raw.withColumn("Referral Date", F.lit("kept"))
    assert {r["Referral Date"] for r in overlay.standardize_dates(own).collect()} == {"kept"}


def test_datasets_by_name(spark):
    raw, base = raw_f1(spark), _dir()
    empty = D.load_dataset(spark, D.ALL, None, f"{base}/none")
    assert empty.count() == 0 and D.load_dataset(spark, D.PREFERRED, None, f"{base}/none").count() == 0
    D.save_cleaned(R.process_referrals(raw), spark.createDataFrame([("A", "x")], "full_name string, specialty string"), base)
    missing = lambda: spark.read.parquet(f"{base}/nowhere")
    for name, n in ((D.INBOUND, 3), (D.OUTBOUND, 2), (D.ALL, 5)):
        for export in (lambda: raw, missing, None, lambda: spark.read.parquet(f"{base}/referrals")):
            assert D.load_dataset(spark, name, export, base).count() == n
    counts = [sorted((r.full_name, r.referral_count) for r in D.load_dataset(spark, D.PROVIDERS, e, base).collect()) for e in (lambda: raw, None)]
    assert counts[0] == counts[1] and len(counts[0]) == 2
    shown = raw.select(F.col("`Referred From Full Name`").alias("Full Name"), F.lit("a").alias("Work Address"), F.lit("p").alias("Work Phone"),
                       F.lit(1.0).alias("Latitude"), F.lit("more").alias("Extra"))
    assert R.is_cleaned(shown) and "Extra" in D.load_dataset(spark, D.ALL, lambda: shown, base).columns


def test_a_source_that_fails_is_an_invalid_row(spark):
    d = _dir()
    with open(f"{d}/good.csv", "w") as f:
        f.write("full_name,latitude,longitude\nA,1.0,2.0\nB,bad,200\nC,10,200\n")
    with open(f"{d}/broken.csv", "w") as f:
        f.write("full_name,latitude,longitude\nA,1.0,2.0\nB\nC,1,2,3,4\n\"D\",5,6\n")
    os.makedirs(f"{d}/odd.parquet")
    with open(f"{d}/odd.parquet/part-0.parquet", "w") as f:
        f.write("not parquet")
    load = lambda name, **a: (lambda: io.load_table(spark, f"{d}/{name}", corrupt_col="_corrupt", **a), ["full_name"])
    failing = spark.range(3).select(F.when(F.col("id") == 2, F.raise_error(F.lit("lost"))).otherwise(F.lit("x")).cast("string").alias("full_name"))
    got = {r.dataset: r for r in preparation.validate_sources(spark, {
        "good": load("good.csv"), "broken": load("broken.csv"), "missing": load("missing.csv"), "odd": load("odd.parquet"),
        "running": (lambda: failing, ["full_name"])}).collect()}
    assert got["good"].valid and got["good"].invalid_coordinates == 1 and got["good"].error is None
    assert not got["broken"].valid and (got["broken"].row_count, got["broken"].corrupt_rows) == (4, 2)
    for name in ("missing", "odd", "running"):
        assert not got[name].valid and got[name].row_count == 0 and got[name].error


def test_orders_and_date_choice(spark):
    df = spark.createDataFrame([("b", 2), ("a", 2), ("c", 9)], "full_name string, referral_count long")
    assert [r.full_name for r in rollup.largest_first(df).collect()] == ["c", "a", "b"]
    calls = spark.createDataFrame([("f", 1.0, 1, False), ("g", 5.0, 1, True), ("f", 3.0, 2, False)], "function string, duration_s double, called_at long, failed boolean")
    assert [r.function for r in quality.call_log_rollup(calls).collect()] == ["g", "f"]
    both = spark.createDataFrame([], "date_of_intake string, referral_date string")
    assert rollup.date_column(both) == "referral_date" and rollup.date_column(both, index="date_of_intake") == "date_of_intake"
    assert rollup.date_column(both.drop("referral_date")) == "date_of_intake" and rollup.date_column(df) is None
    phones = spark.createDataFrame([("(301) 555-1234",), ("1 301-555-1234",), ("x-1",), (None,)], "p string").select(text.strip_phone("p").alias("p"))
    assert [r.p for r in phones.collect()] == ["(301) 555-1234", "13015551234", "x1", None]


def _cleanings(monkeypatch):
    from provena.operators import referrals
    calls, clean = [], referrals.process_referrals
    monkeypatch.setattr(referrals, "process_referrals", lambda *a, **k: calls.append(k) or clean(*a, **k))
    return calls


def test_datasets_share_one_cleaning(spark, monkeypatch):
    from provena.plans import queries as Q
    calls = _cleanings(monkeypatch)
    rows = {(r.dataset, r.way): (r.row_count, r.names) for r in Q.dataset_dispatch(spark, "/root/testdata/sf0.001").collect()}
    assert len(calls) == 1 and len(rows) == 15
    assert all(rows[d, "export"] == rows[d, "clean"] == rows[d, "fallback"] and rows[d, "export"][0] > 0 for d, _ in rows)


def test_integrity_report_cleans_the_export_once(spark, monkeypatch):
    from provena.plans import queries as Q
    calls = _cleanings(monkeypatch)
    assert Q.integrity_report(spark, "/root/testdata/sf0.001").count() == 5
    assert len(calls) == 1
