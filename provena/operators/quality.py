"""Data-quality reports and the row-level audit job.

Every report is a single aggregate pass (``count_if`` counters in one
``agg``) or a ``groupBy``; the per-row validators are re-aimed as one
audit job that turns a table into ``(row, check, ok, message)`` rows by
exploding an array of check results — one scan, not one scan per check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena import schema as S
from provena.functions import time as tfn
from provena.functions.common import try_cast
from provena.schema import AUDIT_MESSAGES as M


def _blankish(c: str) -> Column:
    col = F.col(c)
    return col.isNull() | F.trim(col.cast("string")).isin(*S.MISSING_TOKENS)


def data_quality(df: DataFrame) -> DataFrame:
    """Totals, missing name/address/phone, invalid geocodes (lat ±90, lon ±180)."""
    bad_geo = (F.col("latitude").isNull() | F.col("longitude").isNull()
               | (F.abs("latitude") > S.REPORT_LAT_MAX) | (F.abs("longitude") > S.REPORT_LON_MAX))
    return df.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(_blankish("full_name")).alias("missing_names"),
        F.count_if(_blankish("work_address")).alias("missing_addresses"),
        F.count_if(_blankish("work_phone")).alias("missing_phones"),
        F.count_if(bad_geo).alias("invalid_geocodes"),
    )


def integrity(df: DataFrame, dataset: str, required: list[str], columns: list[str] | None = None, extra: list[Column] = ()) -> DataFrame:
    """One row: valid flag, rows, columns, missing required, duplicate names, bad coords, % missing cells.

    ``duplicate_names`` = rows − distinct names, counting null as a value.
    The missing-cell share is one pass of per-column null counters over
    ``columns`` (all by default); ``extra`` aggregates ride along.
    """
    columns = df.columns if columns is None else columns
    missing = [c for c in required if c not in columns]
    ncols = len(columns)
    has_geo = "latitude" in df.columns and "longitude" in df.columns
    lat, lon = (try_cast(c, "double") for c in ("latitude", "longitude")) if has_geo else (None, None)  # text in a raw file
    bad = lat.isNotNull() & lon.isNotNull() & ((F.abs(lat) > 90) | (F.abs(lon) > 180)) if has_geo else F.lit(False)
    nulls = sum((F.count_if(F.col(f"`{c}`").isNull()) for c in columns), F.lit(0))
    dup = (F.count(F.lit(1)) - F.count_distinct(F.struct("full_name"))) if "full_name" in df.columns else F.lit(0)
    rows = F.count(F.lit(1))
    return df.agg(
        F.lit(dataset).alias("dataset"),
        (F.lit(len(missing) == 0) & (rows > 0)).alias("valid"),
        rows.alias("row_count"),
        F.lit(ncols).alias("column_count"),
        F.lit(", ".join(missing)).alias("missing_required_columns"),
        dup.cast("bigint").alias("duplicate_names"),
        F.count_if(bad).alias("invalid_coordinates"),
        F.when(rows > 0, F.round(nulls / (rows * F.lit(ncols)) * 100, 2)).otherwise(F.lit(0.0)).alias("missing_values_pct"),
        *extra,
    )


def validate_all(datasets: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """D8 for each dataset, unioned."""
    out = None
    for name, (df, req) in datasets.items():
        one = integrity(df, name, req)
        out = one if out is None else out.unionByName(one)
    return out


def provider_validation(df: DataFrame) -> DataFrame:
    """Tall ``(severity, metric, value)`` report from one aggregate; ``valid`` ⇔ no issue counts."""
    agg = df.agg(
        F.count_if(F.col("latitude").isNull() | F.col("longitude").isNull()).cast("double").alias("missing_coordinates"),
        F.count_if(F.col("referral_count").isNull()).cast("double").alias("invalid_referral_counts"),
        F.count_if(F.col("referral_count") == 0).cast("double").alias("zero_referral_providers"),
        F.round(F.avg("referral_count"), 1).alias("avg_referrals"),
        F.max("referral_count").cast("double").alias("max_referrals"),
        F.count(F.lit(1)).cast("double").alias("total_providers"),
    )
    stack = ("stack(6, 'issue', 'missing_coordinates', missing_coordinates, 'issue', 'invalid_referral_counts', "
             "invalid_referral_counts, 'info', 'zero_referral_providers', zero_referral_providers, 'info', "
             "'avg_referrals', avg_referrals, 'info', 'max_referrals', max_referrals, 'info', 'total_providers', "
             "total_providers) as (severity, metric, value)")
    return agg.selectExpr(stack)


def us_bounds_audit(df: DataFrame) -> DataFrame:
    """Rows outside lat [20,70] / lon [-180,-60] after null → 0 (report only)."""
    lat = F.coalesce(F.col("latitude"), F.lit(0.0))
    lon = F.coalesce(F.col("longitude"), F.lit(0.0))
    (lo_lat, hi_lat), (lo_lon, hi_lon) = S.US_LAT_RANGE, S.US_LON_RANGE
    bad = (lat < lo_lat) | (lat > hi_lat) | (lon < lo_lon) | (lon > hi_lon)
    return df.agg(F.count(F.lit(1)).alias("providers"), F.count_if(bad).alias("outside_us_bounds"))


def issue_records(df: DataFrame, checks: list[tuple[str, str]]) -> DataFrame:
    """Every failing (row, reason); a row fails once per failing check — one scan."""
    present = [(c, r) for c, r in checks if c in df.columns]
    if not present:
        return df.limit(0).withColumn("issue", F.lit(None).cast("string"))
    reasons = F.array(*[F.when(_blankish(c), F.lit(r)) for c, r in present])
    return df.withColumn("issue", F.explode(F.filter(reasons, lambda x: x.isNotNull())))


def type_distribution(referrals: DataFrame) -> DataFrame:
    """D18."""
    return referrals.groupBy("referral_type").agg(F.count(F.lit(1)).alias("referrals"))


def coverage_stats(referrals: DataFrame) -> DataFrame:
    """Unique providers, date range, complete-contact rows, geocoded rows and share."""
    complete = ~_blankish("full_name") & ~_blankish("work_address") & ~_blankish("work_phone")
    geo = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    n = F.count(F.lit(1))
    return referrals.agg(
        F.count_distinct("full_name").alias("unique_providers"),
        F.min("date_of_intake").alias("first_intake"),
        F.max("date_of_intake").alias("last_intake"),
        F.count_if(complete).alias("complete_contact_rows"),
        F.count_if(geo).alias("geocoded_rows"),
        F.when(n > 0, F.round(F.count_if(geo) / n * 100, 2)).alias("geocoded_pct"),
    )


def null_profile(df: DataFrame) -> DataFrame:
    """Null count and non-null share per column, tall, from one aggregate."""
    n = F.count(F.lit(1))
    aggs = [F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)]
    wide = df.agg(n.alias("_rows"), *aggs)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("null_count"))
                      for i, c in enumerate(df.columns)])
    return (wide.select("_rows", F.inline(pairs))
            .select("column", "null_count",
                    F.when(F.col("_rows") > 0, F.round((F.col("_rows") - F.col("null_count")) / F.col("_rows") * 100, 2))
                    .alias("non_null_pct")))


def duplicate_address_savings(df: DataFrame, address_col: str = "work_address") -> DataFrame:
    """Addresses with more than one record, their records, and look-ups saved."""
    per = df.filter(F.col(address_col).isNotNull()).groupBy(address_col).agg(F.count(F.lit(1)).alias("n"))
    dup = per.filter(F.col("n") > 1)
    return dup.agg(F.count(F.lit(1)).alias("duplicate_addresses"),
                   F.coalesce(F.sum("n"), F.lit(0)).alias("records"),
                   F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("lookups_saved"))


def freshness_breakdown(providers: DataFrame, as_of: str, stale_days: int = 90, very_stale_days: int = 180) -> DataFrame:
    """Providers per freshness status at ``as_of``."""
    st = tfn.freshness_status("last_verified_date", as_of, stale_days, very_stale_days)
    return providers.groupBy(st.alias("status")).agg(F.count(F.lit(1)).alias("providers"))


def call_log_rollup(calls: DataFrame, slow_threshold_s: float = 10.0) -> DataFrame:
    """Per function — calls, avg/max duration, error %, last call, slow flag; slowest first."""
    agg = calls.groupBy("function").agg(
        F.count(F.lit(1)).alias("calls"),
        F.avg("duration_s").alias("avg_s"),
        F.max("duration_s").alias("max_s"),
        (F.count_if(F.col("failed")) / F.count(F.lit(1)) * 100).alias("error_pct"),
        F.max("called_at").alias("last_call"),
    )
    return agg.withColumn("slow", F.col("avg_s") > F.lit(slow_threshold_s)).orderBy(F.desc("avg_s"), "function")


def bidirectional_providers(referrals: DataFrame) -> DataFrame:
    """Names that appear both as inbound and outbound parties (semi join of distinct names)."""
    inbound = referrals.filter(F.col("referral_type") == "inbound").select("full_name").filter(F.col("full_name").isNotNull())
    outbound = referrals.filter(F.col("referral_type") == "outbound").select("full_name")
    return inbound.intersect(outbound)


# ---------------------------------------------------------------------------
# Audit job
# ---------------------------------------------------------------------------
_ZIP = r"^[0-9]{5}(-[0-9]{4})?$"


def _empty(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def address_parts_check(street: Column, city: Column, state: Column, zip_: Column) -> tuple[Column, Column]:
    """H24 (strict): ``(ok, message)`` — all four parts required, ZIP ``12345[-6789]``."""
    msgs = F.array(
        F.when(_empty(street), F.lit(M["street_required"])),
        F.when(_empty(city), F.lit(M["city_required"])),
        F.when(_empty(state), F.lit(M["state_required"])),
        F.when(_empty(zip_), F.lit(M["zip_required"])),
        F.when(zip_.isNotNull() & (zip_ != "") & ~F.trim(zip_).rlike(_ZIP),
               F.lit(M["zip_format"])),
    )
    issues = F.filter(msgs, lambda x: x.isNotNull())
    ok = F.size(issues) == 0
    return ok, F.when(ok, F.lit(M["address_valid"])).otherwise(F.array_join(issues, "; "))


def address_parts_advice(street: Column, city: Column, state: Column, zip_: Column) -> tuple[Column, Column, Column]:
    """H25 (advisory): ``(ok, errors, suggestions)`` — only the street is required."""
    st = F.upper(F.trim(state))
    z = F.trim(zip_)
    errors = F.filter(F.array(F.when(_empty(street), F.lit(M["street_required"]))), lambda x: x.isNotNull())
    sugg = F.array(
        F.when(_empty(city), F.lit(M["city_recommended"])),
        F.when(_empty(state), F.lit(M["state_recommended"])),
        F.when(~_empty(state) & (F.length(st) == 2) & ~st.isin(*S.STATE_CODES.values()),
               F.concat(F.lit("'"), state, F.lit(M["state_unknown_suffix"]))),
        F.when(~_empty(state) & (F.length(st) > 2),
               F.lit(M["state_two_letters"])),
        F.when(~_empty(zip_) & ~z.rlike(r"^[0-9]{5}$") & ~z.rlike(r"^[0-9]{5}-[0-9]{4}$"),
               F.lit(M["zip_advice"])),
        F.when(~_empty(street) & F.lower(F.trim(street)).isin(*S.TEST_STREETS),
               F.lit(M["test_street"])),
    )
    return F.size(errors) == 0, errors, F.filter(sugg, lambda x: x.isNotNull())


def free_address_check(addr: Column) -> tuple[Column, Column]:
    """``(ok, message)`` for a one-line address."""
    a = F.trim(addr)
    has_hint = a.rlike(r"\b[A-Z]{2}\b") | a.rlike(r"[0-9]{5}(-[0-9]{4})?\b")
    ok = ~_empty(addr) & (F.length(a) >= 10) & a.rlike("[0-9]")
    msg = (F.when(_empty(addr), F.lit(M["address_empty"]))
           .when(F.length(a) < 10, F.lit(M["address_short"]))
           .when(~a.rlike("[0-9]"), F.lit(M["address_number"]))
           .when(~has_hint, F.lit(M["address_hint"]))
           .otherwise(F.lit("")))
    return ok, msg


def coordinate_check(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Numeric, |lat| ≤ 90, |lon| ≤ 180."""
    la, lo = try_cast(lat.cast("string"), "double"), try_cast(lon.cast("string"), "double")
    msg = (F.when(la.isNull() | lo.isNull() | F.isnan(la) | F.isnan(lo), F.lit(M["coords_numeric"]))
           .when((la < -90) | (la > 90), F.lit(M["lat_range"]))
           .when((lo < -180) | (lo > 180), F.lit(M["lon_range"]))
           .otherwise(F.lit(M["coords_valid"])))
    return msg == M["coords_valid"], msg


def phone_check(phone: Column) -> tuple[Column, Column]:
    """Blank is fine; 10 digits, or 11 starting with 1."""
    d = F.regexp_replace(phone, "[^0-9]", "")
    msg = (F.when(_empty(phone), F.lit(M["phone_optional"]))
           .when(F.length(d) == 10, F.lit(M["phone_valid"]))
           .when((F.length(d) == 11) & d.startswith("1"), F.lit(M["phone_valid"]))
           .otherwise(F.lit(M["phone_invalid"])))
    return msg != M["phone_invalid"], msg


def audit(df: DataFrame, key: str, address: str | None = None, lat: str | None = None, lon: str | None = None,
          phone: str | None = None, parts: tuple[str, str, str, str] | None = None) -> DataFrame:
    """H24–H28 as one job: ``(key, check, ok, message)`` for every row and configured check."""
    checks = []
    if parts:
        ok, msg = address_parts_check(*[F.col(p) for p in parts])
        checks.append(F.struct(F.lit("address_parts").alias("check"), ok.alias("ok"), msg.alias("message")))
    if address:
        ok, msg = free_address_check(F.col(address))
        checks.append(F.struct(F.lit("address").alias("check"), ok.alias("ok"), msg.alias("message")))
    if lat and lon:
        ok, msg = coordinate_check(F.col(lat), F.col(lon))
        checks.append(F.struct(F.lit("coordinates").alias("check"), ok.alias("ok"), msg.alias("message")))
    if phone:
        ok, msg = phone_check(F.col(phone))
        checks.append(F.struct(F.lit("phone").alias("check"), ok.alias("ok"), msg.alias("message")))
    return df.select(F.col(key), F.inline(F.array(*checks)))


def audit_summary(audited: DataFrame) -> DataFrame:
    """Per-check pass/fail counts of an audit."""
    return audited.groupBy("check").agg(F.count_if(F.col("ok")).alias("passed"),
                                        F.count_if(~F.col("ok")).alias("failed"))


def output_schema_check(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """For each expected column — present, and how many non-null values fail the expected type."""
    checks = []
    for col, typ in expected.items():
        if col in df.columns:
            bad = F.count_if(F.col(col).isNotNull() & try_cast(F.col(col).cast("string"), typ).isNull())
            checks.append(F.struct(F.lit(col).alias("column"), F.lit(True).alias("present"), bad.alias("bad_values")))
        else:
            checks.append(F.struct(F.lit(col).alias("column"), F.lit(False).alias("present"),
                                   F.lit(0).cast("bigint").alias("bad_values")))
    return df.agg(F.array(*checks).alias("c")).select(F.inline("c"))


def referral_statistics(referrals: DataFrame) -> DataFrame:
    """Per referral type — referrals, providers, and referrals per provider (max, exact median)."""
    per = (referrals.filter(F.col("full_name").isNotNull())
           .groupBy("referral_type", "full_name").agg(F.count(F.lit(1)).alias("n")))
    return per.groupBy("referral_type").agg(
        F.sum("n").alias("referrals"), F.count(F.lit(1)).alias("providers"),
        F.max("n").alias("max_per_provider"), F.percentile("n", 0.5).alias("median_per_provider"))


def providers_missing_geo(providers: DataFrame) -> DataFrame:
    """D24 (second report): providers without usable coordinates."""
    return providers.filter(F.col("latitude").isNull() | F.col("longitude").isNull()
                            | (F.col("latitude") == 0) | (F.col("longitude") == 0))


def preferred_share(providers: DataFrame, alarm_pct: float = 80.0) -> DataFrame:
    """Share of providers marked preferred (percent) and the too-many alarm."""
    pct = F.avg(F.col("preferred").cast("double")) * 100
    return providers.agg(F.count_if(F.col("preferred")).alias("preferred_count"),
                         F.count(F.lit(1)).alias("total_count"),
                         F.round(pct, 1).alias("preferred_pct"),
                         (pct > alarm_pct).alias("alarm"))


def freshness_table(providers: DataFrame, as_of: str, stale_days: int = 90, very_stale_days: int = 180) -> DataFrame:
    """H14 + H15 per provider: age in days, status and the display string."""
    d = F.col("last_verified_date")
    return providers.select("full_name", tfn.age_days(d, as_of).alias("age_days"),
                            tfn.freshness_status(d, as_of, stale_days, very_stale_days).alias("status"),
                            tfn.freshness_display(d, as_of, stale_days, very_stale_days).alias("display"))
