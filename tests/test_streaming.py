"""Streaming intake: the tables it keeps equal the batch rules however the input is cut into batches."""

import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from provena.operators import referrals as R, rollup
from provena.session import settings
from provena.sources.keyed import upsert
from provena.streaming import intake as S
from tests.test_fixtures import DOC

COLS = ["Project ID", "Date of Intake", "Referral Source", "Secondary Referral Source", "Secondary Referred From Full Name",
        "Secondary Referred From's Work Address", "Secondary Referred From's Work Phone", "Secondary Referred From's Details: Latitude",
        "Secondary Referred From's Details: Longitude", "Secondary Referred From's Details: Person ID"]


def _dir():
    return tempfile.mkdtemp(prefix="provena-stream-", dir="/tmp")


def _batch(spark, rows, seq=True):
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in COLS))
    return df.withColumn("_seq", F.col("`Project ID`").cast("long")) if seq else df


def _row(i, day, name, pid, phone="301-555-0001"):
    return (str(i), day, "x", DOC, name, "1 St", phone, "39.0", "-76.0", pid)


def _random_rows(n, seed):
    rng = random.Random(seed)
    days = ["2024-01-31", "2024-02-01", "45322", None, "2023-12-31 23:59:59", "2024-02-29"]
    return [_row(i, rng.choice(days), f"Dr. {rng.randrange(5)}", rng.choice([None, "P1", "P2", "P3", f"Q{i}"]), rng.choice(["301-555-0001", None]))
            for i in range(n)]


def _canon(df):
    cols = sorted(df.columns)
    return sorted(str([r[c] for c in cols]) for r in df.collect())


def _drain(spark, batches, run, **parameters):
    d = _dir()
    for b in batches:
        b.coalesce(1).write.mode("append").parquet(f"{d}/landing")
        run(spark, f"{d}/landing", batches[0].schema, f"{d}/target", f"{d}/ck", **parameters)
    return f"{d}/target"


@pytest.mark.parametrize("cuts", [[1, 25]])
def test_tables_equal_batch_after_any_split(spark, cuts):
    rows = _random_rows(40, 1)
    whole = _batch(spark, rows)
    random.Random(len(cuts)).shuffle(rows)  # arrival isn't the input's order
    parts = [_batch(spark, rows[a:z]) for a, z in zip([0, *cuts], [*cuts, 40]) if z > a]
    first = _drain(spark, parts, S.run_first_seen, files_per_trigger=1)
    for mode in ("reference", "keep_null_ids"):
        assert _canon(S.read_first_seen(spark, first, mode)) == _canon(R.process_referrals(whole, dedup=mode).drop("_seq"))
    long = R.split_referrals(whole)
    counts = S.read_running_counts(spark, _drain(spark, parts, S.run_running_counts, files_per_trigger=1))
    assert _canon(counts) == _canon(S.running_counts(long))
    # a window of whole months is D2
    months = counts.filter(F.col("month").isin("2024-01", "2024-02")).groupBy(*S.COUNT_KEYS).agg(F.sum("referrals").alias("referral_count"))
    assert _canon(months) == _canon(rollup.referral_counts(long, "2024-01-01 00:00:00", "2024-02-29 23:59:59"))


def test_party_whose_first_id_comes_late(spark):
    """Rows without an ID are kept one by one until their party brings an ID, then they are one group."""
    d = _drain(spark, [_batch(spark, [_row(1, "2024-01-01", "A", None), _row(2, "2024-01-01", "B", None)])], S.run_first_seen)
    assert S.read_first_seen(spark, d).count() == 2
    both = [_batch(spark, [_row(1, "2024-01-01", "A", None), _row(2, "2024-01-01", "B", None)]), _batch(spark, [_row(3, "2024-01-02", "C", "P9")])]
    d = _drain(spark, both, S.run_first_seen)
    assert sorted(r.full_name for r in S.read_first_seen(spark, d).collect()) == ["A", "C"]
    assert sorted(r.full_name for r in S.read_first_seen(spark, d, "keep_null_ids").collect()) == ["A", "B", "C"]


def test_exports_without_a_sequence_go_by_arrival(spark):
    parts = [_batch(spark, [_row(9, "2024-01-03", "first", "P1")], seq=False), _batch(spark, [_row(1, "2024-01-01", "later", "P1")], seq=False)]
    d = _drain(spark, parts, S.run_first_seen)
    assert [r.full_name for r in S.read_first_seen(spark, d).collect()] == ["first"]


def test_bounded_variant_misses_repeats_beyond_the_watermark_only(spark):
    batches = [_batch(spark, [r]) for r in (
        _row(1, "2024-01-01", "A", "P1"), _row(2, "2024-01-20", "A again", "P1"), _row(3, "2024-06-01", "B", "P2"), _row(4, None, "no id", None),
        _row(5, None, "no id", None))]
    # Each file is a batch: the watermark follows the data.
    batches += [_batch(spark, [_row(6, "2024-06-02", "A long after", "P1")]), _batch(spark, [_row(7, "2024-06-03", "B again", "P2")])]
    d = _drain(spark, [*batches[:3], *batches[5:], *batches[3:5]], S.run_first_seen_bounded, watermark="30 days", files_per_trigger=1)
    got = sorted(r.full_name for r in spark.read.parquet(d).collect())
    assert got == ["A", "A long after", "B", "no id", "no id"]


def test_counts_survive_a_replayed_batch(spark):
    """The state's totals are written, not added: the same update twice leaves the same table."""
    d = _dir()
    rows = spark.createDataFrame([("inbound", "A", "1 St", "p", 1.0, 2.0, 3, "2024-01"), ("inbound", "A", "1 St", "p", 1.0, 2.0, 1, "2024-02")], S.COUNT_SCHEMA)
    keys = ["referral_type", *S.COUNT_KEYS, "month"]
    for update in (rows, rows, rows.withColumn("referrals", F.lit(9).cast("long")).filter("month = '2024-02'")):
        upsert(f"{d}/t", update, keys, "month")
    assert sorted((r.month, r.referrals) for r in S.read_running_counts(spark, f"{d}/t").collect()) == [("2024-01", 3), ("2024-02", 9)]


def test_only_touched_months_are_rewritten(spark):
    d = _drain(spark, [_batch(spark, [_row(1, "2024-01-05", "A", "P1"), _row(2, "2024-02-05", "A", "P2")])], S.run_running_counts)
    files = lambda m: sorted(os.listdir(f"{d}/month={m}"))
    before = files("2024-01"), files("2024-02")
    land, ck = d.replace("/target", "/landing"), d.replace("/target", "/ck")
    more = _batch(spark, [_row(3, "2024-02-06", "A", "P3"), _row(4, "2024-03-01", "A", "P4")])
    more.coalesce(1).write.mode("append").parquet(land)
    S.run_running_counts(spark, land, more.schema, d, ck)
    assert files("2024-01") == before[0] and files("2024-02") != before[1]
    assert sorted((r.month, r.referrals) for r in S.read_running_counts(spark, d).collect()) == [("2024-01", 1), ("2024-02", 2), ("2024-03", 1)]


def test_intake_matches_batch_split(spark):
    rows = _batch(spark, [_row(1, "2024-01-01", "Dr. A", "P1"), _row(2, "45500", "Dr. B", "P2")])
    d = _drain(spark, [rows], S.run_intake)
    assert _canon(spark.read.parquet(d).drop("_seq")) == _canon(R.split_referrals(rows).drop("_cfg", "_seq"))


def test_nothing_drained(spark):
    d = _dir()
    assert S.read_first_seen(spark, f"{d}/none").count() == 0 and S.read_running_counts(spark, f"{d}/none").count() == 0


def test_bounded_state_keys_are_no_texts_of_places(spark):
    """Rows without an ID pass once for each place, a repeat of one doesn't; their keys in the state are the places as they are."""
    batches = [_batch(spark, [_row(1, "2024-06-01", "A", "P1"), _row(2, "2024-06-01", "no id", None)]), _batch(spark, [_row(3, "2024-06-02", "B", "P2")]),
               _batch(spark, [_row(4, "2024-06-02", "no id", None), _row(5, "2024-06-03", "A again", "P1"), _row(2, "2024-06-01", "no id", None)])]
    d = _drain(spark, batches, S.run_first_seen_bounded, watermark="90 days", files_per_trigger=1)
    assert sorted(r.full_name for r in spark.read.parquet(d).collect()) == ["A", "B", "no id", "no id"]
    with settings(spark, S.ROCKSDB_STATE):
        keys = spark.read.format("statestore").load(d.replace("/target", "/ck")).select("key.*")
        assert keys.count() == 4 and sorted(t for _, t in keys.dtypes) == ["bigint", "int", "string"]
        assert {r.person_id for r in keys.collect()} == {"P1", "P2", None}
