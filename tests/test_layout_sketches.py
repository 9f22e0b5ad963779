"""Z-order layout: files that scans skip.  Sketches: merged loads against exact figures."""

import glob
import random
import tempfile

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from provena.functions.geo import haversine_miles
from provena.operators import quality, sketches
from provena.sources import io, layout


def _referrals(spark, n=6000):
    rnd = random.Random(4)
    rows = []
    for i in range(n):
        city = i % 3 == 0  # a third of all rows in one city
        lat, lon = (38.9 + rnd.gauss(0, 0.05), -77.0 + rnd.gauss(0, 0.05)) if city else (rnd.uniform(25, 49), rnd.uniform(-124, -67))
        rows.append((i, f"2024-{rnd.randrange(1, 13):02d}-{rnd.randrange(1, 29):02d}", f"n{rnd.randrange(700)}", lat if i % 50 else None, lon, "inbound" if i % 4 else "outbound"))
    return spark.createDataFrame(rows, "project_id long, d string, full_name string, latitude double, longitude double, referral_type string").withColumn(
        "date_of_intake", F.col("d").cast("timestamp_ntz")).drop("d")


def _touched(path, **ranges):
    """Files whose statistics overlap all ranges: those a scan can't skip."""
    n = 0
    for f in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        names = [meta.schema.column(i).name for i in range(meta.num_columns)]
        stats = {c: meta.row_group(0).column(names.index(c)).statistics for c in ranges}
        n += all(s.min <= hi and s.max >= lo for (lo, hi), s in zip(ranges.values(), stats.values()) if s.has_min_max)
    return n, len(glob.glob(f"{path}/*.parquet"))


def test_scans_skip_files(spark):
    d = tempfile.mkdtemp(prefix="provena-layout-", dir="/tmp")
    df = _referrals(spark)
    io.write_clustered(df, f"{d}/z", files=64)
    df.repartitionByRange(64, "date_of_intake").sortWithinPartitions("date_of_intake").write.parquet(f"{d}/by_date")
    import datetime as dt
    window = {"date_of_intake": (dt.datetime(2024, 3, 1), dt.datetime(2024, 3, 31))}
    city = {"latitude": (38.6, 39.2), "longitude": (-77.4, -76.6)}
    far = {"latitude": (44.0, 46.0), "longitude": (-112.0, -109.0)}
    z_files = _touched(f"{d}/z")[1]
    assert z_files >= 48
    assert _touched(f"{d}/z", **far)[0] <= z_files // 4 and _touched(f"{d}/by_date", **far)[0] >= 60
    # 64 files are four intervals a dimension, and a month that straddles two of them touches a little over half.
    assert _touched(f"{d}/z", **window)[0] <= 0.6 * z_files
    assert _touched(f"{d}/z", **city)[0] <= 0.7 * z_files and _touched(f"{d}/z", **city, **window)[0] <= z_files // 4
    stored = spark.read.parquet(f"{d}/z")
    assert sorted(map(str, stored.collect())) == sorted(map(str, df.collect()))
    near = haversine_miles(F.lit(45.0), F.lit(-110.0), "latitude", "longitude") <= 60.0
    box = layout.in_box(45.0, -110.0, 60.0)
    assert stored.filter(box & near).count() == df.filter(near).count()
    before = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = stored.filter(box & near)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.maxMetadataStringLength", before)
    assert "GreaterThanOrEqual(latitude" in plan and "LessThanOrEqual(longitude" in plan


def test_boxes_hold_their_circles(spark):
    rnd = random.Random(1)
    pts = spark.createDataFrame([(rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for _ in range(3000)], "latitude double, longitude double")
    for lat, lon, r in ((0.0, 0.0, 500.0), (85.0, 10.0, 300.0), (89.5, 0.0, 100.0), (10.0, 179.5, 400.0), (-60.0, -179.0, 900.0), (45.0, 20.0, 8000.0)):
        near = haversine_miles(F.lit(lat), F.lit(lon), "latitude", "longitude") <= r
        assert pts.filter(near & ~layout.in_box(lat, lon, r)).count() == 0



def test_layout_of_an_empty_table(spark):
    d = tempfile.mkdtemp(prefix="provena-layout-", dir="/tmp")
    io.write_clustered(_referrals(spark, 10).limit(0), f"{d}/z")
    assert spark.read.schema("project_id long").parquet(f"{d}/z").count() == 0


def test_merged_sketches_are_within_the_bound(spark):
    df = _referrals(spark).withColumn("full_name", F.concat("full_name", F.lit("-"), F.pmod("project_id", F.lit(9))))
    by_load = sketches.load_sketches(df, F.pmod("project_id", F.lit(5)))
    got = {r.referral_type: r for r in sketches.merged(by_load).collect()}
    exact = {r.referral_type: r for r in df.groupBy("referral_type").agg(F.count("*").alias("n"), F.count_distinct("full_name").alias("names")).collect()}
    other = {r.referral_type: r for r in sketches.merged(sketches.load_sketches(df, F.pmod(F.xxhash64("project_id"), F.lit(3)))).collect()}
    for kind, e in exact.items():
        assert got[kind].referrals == e.n and got[kind].loads == 5
        assert abs(got[kind].providers / e.names - 1) <= sketches.ERROR_BOUND
        assert abs(other[kind].providers / e.names - 1) <= sketches.ERROR_BOUND  # however the rows were cut into loads
    exact = {r.referral_type: r for r in quality.referral_statistics(df).collect()}
    for r in sketches.approximate_statistics(df).collect():
        e = exact[r.referral_type]
        assert (r.referrals, r.providers, r.max_per_provider) == (e.referrals, e.providers, e.max_per_provider)
        assert abs(r.median_per_provider - e.median_per_provider) <= 1


def test_keys_are_plain_expressions(spark):
    """The interleaved key has the bits of its steps in turn, and nothing in it is interpreted row by row."""
    rnd = random.Random(3)
    rows = [tuple(rnd.randrange(1 << 16) for _ in range(3)) for _ in range(200)] + [(0, 0, 0), (65535, 65535, 65535)]
    df = spark.createDataFrame(rows, "a long, b long, c long")
    got = df.select("a", "b", "c", layout.interleaved([F.col(x) for x in "abc"]).alias("z")).collect()
    for r in got:
        assert r.z == sum((r[i] >> b & 1) << (b * 3 + 2 - i) for b in range(16) for i in range(3))
    dealt = layout.z_ordered(_referrals(spark, 500), files=4)
    assert "lambda" not in dealt._jdf.queryExecution().optimizedPlan().toString()
    assert dealt.count() == 500 and layout.z_ordered(_referrals(spark, 60).withColumn("latitude", F.lit(None).cast("double")), files=4).count() == 60


def test_clustered_files_come_from_a_stored_table(spark, monkeypatch):
    """Cuts, ranges and rows read the cleaned referrals, not the export, of which they'd be three cleanings."""
    from provena.plans import queries as Q
    seen = []
    write = io.write_clustered
    monkeypatch.setattr(io, "write_clustered", lambda df, *a, **k: seen.append(df.inputFiles()) or write(df, *a, **k))
    Q.clustered_window(spark, "/root/testdata/sf0.001")
    assert seen[0] and all("/tables/" in f for f in seen[0])
