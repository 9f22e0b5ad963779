"""Replays of the application's own fixtures (see FIXTURES.md) through the Spark operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from provena.functions import geo, text
from provena.functions import time as T
from provena.functions.score import Weights
from provena.operators import enrich, preferred, quality, recommend as rec, referrals as R, rollup

DOC = "Referral - Doctor's Office"


def raw_f1(spark, with_person_ids=False):
    cols = ["Project ID", "Date of Intake", "Referral Source", "Referred From Full Name", "Referred From's Work Phone",
            "Referred From's Work Address", "Referred From's Details: Latitude", "Referred From's Details: Longitude",
            "Secondary Referral Source", "Secondary Referred From Full Name", "Secondary Referred From's Work Phone",
            "Secondary Referred From's Work Address", "Secondary Referred From's Details: Latitude",
            "Secondary Referred From's Details: Longitude", "Dr/Facility Referred To Full Name",
            "Dr/Facility Referred To's Work Phone", "Dr/Facility Referred To's Work Address",
            "Dr/Facility Referred To's Details: Latitude", "Dr/Facility Referred To's Details: Longitude"]
    rows = [
        ("1001", "2024-01-15", DOC, "Dr. Primary", "301-555-1234", "1 Main St, Annapolis, MD", "38.9784", "-76.4922",
         DOC, "Dr. Secondary", "4105550000", "2 Side St, Baltimore, MD", "39.2904", "-76.6122",
         "Clinic Destination", "2025559876", "10 Care Blvd, Washington, DC", "38.9072", "-77.0369"),
        ("1002", "45500", DOC, "Dr. Solo", "", "3 Another Rd, Bowie, MD", "39.0068", "-76.7791",
         None, None, None, None, None, None,
         "Therapy Partners", None, "20 Wellness Ave, Greenbelt, MD", "39.0046", "-76.8755"),
    ]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in cols))


def test_f1_counts_and_cleaning(spark):
    out = R.process_referrals(raw_f1(spark))
    counts = {r["referral_type"]: r["count"] for r in out.groupBy("referral_type").count().collect()}
    assert counts == {"inbound": 3, "outbound": 2}
    rows = {r["full_name"]: r for r in out.collect()}
    assert rows["Dr. Primary"]["work_phone"] == "(301) 555-1234"
    assert rows["Dr. Solo"]["work_phone"] is None
    assert rows["Clinic Destination"]["latitude"] == pytest.approx(38.9072)
    assert rows["Therapy Partners"]["referral_source"] == "Outbound Referral"
    # Excel serial 45500 is 2024-07-27
    assert rows["Dr. Solo"]["date_of_intake"] == dt.datetime(2024, 7, 27)


def test_f1_empty_input(spark):
    empty = spark.createDataFrame([], "`Project ID` string, `Date of Intake` string")
    out = R.process_referrals(empty)
    assert out.count() == 0


def test_f1_missing_column_report(spark):
    rep = R.missing_columns(raw_f1(spark)).collect()
    missing = {(r["config"], r["column"]) for r in rep}
    assert ("outbound", "Dr/Facility Referred To's Details: Person ID") in missing
    assert all(not r["required"] for r in rep if "Person ID" in r["column"])


def test_person_id_dedup_keeps_first(spark):
    rows = [("1", "2024-01-01", DOC, "Dr. A", "1 St", "39.0", "-76.0", "P1", "Clinic", "38.0", "-77.0", "C1"),
            ("2", "2024-01-02", DOC, "Dr. A again", "1 St", "39.0", "-76.0", "P1", "Clinic 2", "38.0", "-77.0", "C1"),
            ("3", "2024-01-03", DOC, "Dr. B", "2 St", "39.1", "-76.1", "P2", "Clinic 3", "38.1", "-77.1", "C2")]
    cols = ["Project ID", "Date of Intake", "Referral Source", "Referred From Full Name",
            "Referred From's Work Address", "Referred From's Details: Latitude", "Referred From's Details: Longitude",
            "Referred From's Details: Person ID", "Dr/Facility Referred To Full Name",
            "Dr/Facility Referred To's Details: Latitude", "Dr/Facility Referred To's Details: Longitude",
            "Dr/Facility Referred To's Details: Person ID"]
    raw = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in cols)).withColumn("_seq", F.col("`Project ID`").cast("long"))
    out = R.process_referrals(raw)
    inbound = sorted(r["full_name"] for r in out.filter("referral_type = 'inbound'").collect())
    outbound = sorted(r["full_name"] for r in out.filter("referral_type = 'outbound'").collect())
    assert inbound == ["Dr. A", "Dr. B"]
    assert outbound == ["Clinic", "Clinic 3"]
    nodedup = R.process_referrals(raw, dedup="none")
    assert nodedup.count() == 6


def test_preferred_dedup_by_person_id_or_rows(spark):
    cols = ("`Contact Full Name` string, `Contact's Work Phone` string, `Contact's Work Address` string, "
            "`Contact's Details: Latitude` double, `Contact's Details: Longitude` double, `Contact's Details: Person ID` string, _seq long")
    rows = [("A", "1", "x", 39.0, -76.0, "P1", 1), ("A2", "1", "x", 39.0, -76.0, "P1", 2), ("B", "2", "y", None, -76.0, "P2", 3)]
    df = spark.createDataFrame(rows, cols)
    cleaned, missing = preferred.process_preferred(df)
    assert [r["full_name"] for r in cleaned.collect()] == ["A"]
    assert [r["full_name"] for r in missing.collect()] == ["B"]
    no_id = df.drop("Contact's Details: Person ID", "_seq")
    dups = no_id.unionByName(no_id)
    assert preferred.dedup_preferred(dups).count() == 3


@pytest.fixture
def scoring_df(spark):
    return spark.createDataFrame(
        [("Alpha", 40.0, -75.0, 10, 2, 1.0), ("Beta", 40.1, -75.1, 5, 8, 10.0), ("Charlie", 42.0, -76.0, 1, 0, 200.0)],
        "full_name string, latitude double, longitude double, referral_count long, inbound_referral_count long, distance_miles double")


def test_f5_scoring_orders_and_bounds(scoring_df):
    w = Weights(0.7, 0.2, 0.1, 0.0)
    scored = rec.score_candidates(scoring_df, w)
    ranked = rec.rank_scored(scored, w).orderBy("rank").collect()
    assert ranked[0]["full_name"] == "Alpha"
    scores = [r["score"] for r in ranked]
    assert scores == sorted(scores, reverse=True) and min(scores) >= 0


def test_f5_inbound_breaks_ties(spark):
    df = spark.createDataFrame([("A", 0.0, 0.0, 5, 1, 5.0), ("B", 0.0, 0.0, 5, 9, 5.0)],
                               "full_name string, latitude double, longitude double, referral_count long, "
                               "inbound_referral_count long, distance_miles double")
    w = Weights(0.4, 0.4, 0.2, 0.0)
    best = rec.rank_scored(rec.score_candidates(df, w), w).orderBy("rank").first()
    assert best["full_name"] == "B"


def test_f5_min_referrals(scoring_df):
    w = Weights(0.5, 0.5)
    assert rec.score_candidates(scoring_df, w, min_referrals=10).count() == 1
    assert rec.score_candidates(scoring_df, w, min_referrals=1000).count() == 0


@pytest.fixture
def specialty_df(spark):
    rows = [("Dr. Smith", "Chiropractic"), ("Dr. Jones", "Physical Therapy"),
            ("Dr. Johnson", "Chiropractic, Physical Therapy"), ("Dr. Brown", "Neurology"),
            ("Dr. Davis", None), ("Dr. Wilson", "Chiropractic/Physical Therapy")]
    return spark.createDataFrame(rows, "full_name string, specialty string")


def test_f6_specialty_filter(specialty_df):
    got = sorted(r["full_name"] for r in rec.filter_specialty(specialty_df, ["Chiropractic"]).collect())
    assert got == ["Dr. Johnson", "Dr. Smith"]
    assert rec.filter_specialty(specialty_df, []).count() == 6


def test_f6_unique_specialties(specialty_df):
    got = [r["specialty"] for r in rollup.unique_specialties(specialty_df).collect()]
    assert got == ["Chiropractic", "Chiropractic/Physical Therapy", "Neurology", "Physical Therapy"]


@pytest.mark.parametrize("a,b,lo,hi", [
    ((40.7128, -74.0060), (40.7128, -74.0060), 0, 0.01),
    ((40.7128, -74.0060), (39.9526, -75.1652), 75, 90),
    ((38.9072, -77.0369), (39.2904, -76.6122), 30, 45),
    ((40.7128, -74.0060), (38.9072, -77.0369), 160, 240),
    ((40.7128, -74.0060), (34.0522, -118.2437), 2300, 2500),
    ((40.7128, -74.0060), (51.5074, -0.1278), 3400, 3500),
])
def test_f7_distance_bands(spark, a, b, lo, hi):
    df = spark.createDataFrame([(a[0], a[1], b[0], b[1])], "la double, lo double, lb double, lob double")
    d = df.select(geo.haversine_miles("la", "lo", "lb", "lob").alias("d")).first()["d"]
    rev = df.select(geo.haversine_miles("lb", "lob", "la", "lo").alias("d")).first()["d"]
    assert lo <= d <= hi and d == pytest.approx(rev)


def test_f7_null_coordinate(spark):
    df = spark.createDataFrame([(None, -74.0)], "la double, lo double")
    assert df.select(geo.haversine_miles("la", "lo", F.lit(40.0), F.lit(-75.0)).alias("d")).first()["d"] is None


def test_f8_radius_filter(spark):
    miles = [10 / 1.609344, 30 / 1.609344, 40 / 1.609344, 100 / 1.609344]
    df = spark.createDataFrame([(f"p{i}", m) for i, m in enumerate(miles)], "full_name string, distance_miles double")
    assert rec.filter_radius(df, 50 / 1.609344).count() == 3
    assert rec.filter_radius(df, 20 / 1.609344).count() == 1
    none = rec.filter_radius(df, 5 / 1.609344)
    assert none.count() == 0 and none.columns == df.columns


def test_f9_preferred_attribution(spark):
    prov = spark.createDataFrame([("A", "1 St", 5), ("B", "2 St", 3), ("C", "3 St", 1), ("D", "4 St", 7)],
                                 "full_name string, work_address string, referral_count long")
    pref = spark.createDataFrame([("A", "Chiro"), ("C", "PT"), ("E", "Neuro")], "full_name string, specialty string")
    out = {r["full_name"]: r for r in enrich.attach_preferred(prov, pref).collect()}
    assert out["A"]["preferred"] and out["C"]["preferred"] and not out["B"]["preferred"]
    assert out["E"]["preferred"] and out["E"]["work_address"] is None
    assert out["A"]["specialty"] == "Chiro" and out["B"]["specialty"] is None


def test_f10_address_cleaning(spark):
    df = spark.createDataFrame([("  12 Main St, , Town  ", "nan", "maryland", "None")],
                               "a string, city string, state string, zip string")
    r = df.select(text.clean_address("a").alias("a"), text.blank_if_missing("city").alias("c"),
                  text.state_code(F.upper("state")).alias("s"), text.blank_if_missing("zip").alias("z")).first()
    assert r["a"] == "12 Main St, Town" and r["c"] == "" and r["s"] == "MD" and r["z"] == ""


def test_f10_full_address(spark):
    df = spark.createDataFrame([(None, "", "1 St", "Town", "MD", "20746"), ("Kept, Town", "", "x", "y", "z", "w")],
                               "full string, work string, street string, city string, state string, zip string")
    got = [r[0] for r in df.select(text.build_full_address("full", "work", "street", "city", "state", "zip")).collect()]
    assert got == ["1 St, Town, MD, 20746", "Kept, Town"]
    naive = df.select(text.naive_full_address("street", "city", F.lit(""), F.lit(""))).first()[0]
    assert naive == "1 St, Town"


def test_f11_validators(spark):
    df = spark.createDataFrame([("1", "1 Main St", "Town", "MD", "2074", "301-555-1234", "95", "0"),
                                ("2", "1 Main St", "Town", "MD", "20746", "1-301-555-1234", "abc", "0"),
                                ("3", "", "", "", "", "555", "10", "10")],
                               "id string, street string, city string, state string, zip string, phone string, lat string, lon string")
    rows = {(r["id"], r["check"]): r for r in quality.audit(df, "id", lat="lat", lon="lon", phone="phone",
                                                            parts=("street", "city", "state", "zip")).collect()}
    assert rows[("1", "address_parts")]["message"] == "ZIP code must be in format 12345 or 12345-6789"
    assert rows[("2", "address_parts")]["ok"]
    assert rows[("3", "address_parts")]["message"].startswith("Street address is required; City is required")
    assert rows[("1", "coordinates")]["message"] == "Latitude must be between -90 and 90"
    assert rows[("2", "coordinates")]["message"] == "Coordinates must be numeric"
    assert rows[("1", "phone")]["ok"] and rows[("2", "phone")]["ok"] and not rows[("3", "phone")]["ok"]


def test_f12_search_address(spark):
    df = spark.createDataFrame([("1 Main", "Town", "MD", "20746"), ("", "", "", "")], "a string, b string, c string, d string")
    got = [r[0] for r in df.select(text.search_address("a", "b", "c", "d")).collect()]
    assert got == ["1 Main, Town, MD 20746", ""]


def test_phone_formats(spark):
    df = spark.createDataFrame([("4435140560.0",), ("14105550000",), ("12345",), (None,)], "p string")
    got = [r[0] for r in df.select(text.format_phone("p")).collect()]
    assert got == ["(443) 514-0560", "(410) 555-0000", "12345", None]


def test_dates_mixed(spark):
    df = spark.createDataFrame([("2024-01-15",), ("45500",), ("01/15/2024",), ("garbage",), ("",)], "d string")
    got = [r[0] for r in df.select(T.normalize_date("d")).collect()]
    assert got == [dt.datetime(2024, 1, 15), dt.datetime(2024, 7, 27), dt.datetime(2024, 1, 15), None, None]


def test_freshness(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1),), (dt.datetime(2023, 9, 1),), (dt.datetime(2023, 1, 1),), (None,)],
                               "d timestamp_ntz")
    as_of = "2024-02-01 00:00:00"
    got = [r[0] for r in df.select(T.freshness_status("d", as_of)).collect()]
    assert got == ["Fresh", "Stale", "Very Stale", "Unknown"]
    disp = df.select(T.freshness_display("d", as_of)).collect()
    assert disp[0][0] == "✅ 2024-01-01 (31 days ago)" and disp[3][0] == "Not Available"


def test_raw_inbound_counts_window(spark):
    raw = raw_f1(spark)
    everything = {r["full_name"]: r["inbound_referral_count"] for r in rollup.raw_inbound_counts(raw).collect()}
    assert everything == {"Dr. Primary": 1, "Dr. Secondary": 1, "Dr. Solo": 1}
    # Excel serial 45500 is 2024-07-27; only Dr. Solo falls in July
    july = {r["full_name"] for r in rollup.raw_inbound_counts(raw, "2024-07-01 00:00:00", "2024-07-31 00:00:00").collect()}
    assert july == {"Dr. Solo"}
