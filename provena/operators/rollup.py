"""Provider roll-up and referral counts.

All are hash aggregations with map-side partial aggregation, so a hot
provider (even one holding a third of all referrals) is pre-combined in
every map task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.functions import text, time


def provider_rollup(referrals: DataFrame) -> DataFrame:
    """One row per provider name from the (outbound) referral rows.

    ``referral_count`` counts non-null project ids; address, phone,
    coordinates and source are the first non-null values in the cleaned
    order (intake date, then input order); the verification date is the
    latest.  Rows without a name are not grouped (as a pandas group-by).
    Missing text becomes ``""``.
    """
    ordered = (referrals.filter(F.col("full_name").isNotNull())
               .withColumn("_ord", F.struct(F.col("date_of_intake").isNull(), F.col("date_of_intake"), F.col("_seq"))))
    agg = ordered.groupBy("full_name").agg(
        F.count("project_id").alias("referral_count"),
        F.expr("min_by(work_address, _ord) FILTER (WHERE work_address IS NOT NULL)").alias("work_address"),
        F.expr("min_by(work_phone, _ord) FILTER (WHERE work_phone IS NOT NULL)").alias("work_phone"),
        F.expr("min_by(latitude, _ord) FILTER (WHERE latitude IS NOT NULL)").alias("latitude"),
        F.expr("min_by(longitude, _ord) FILTER (WHERE longitude IS NOT NULL)").alias("longitude"),
        F.expr("min_by(referral_source, _ord) FILTER (WHERE referral_source IS NOT NULL)").alias("referral_source"),
        F.max("last_verified_date").alias("last_verified_date"),
    )
    return agg.select(
        "full_name",
        text.text_or_blank("work_address").alias("work_address"),
        text.text_or_blank("work_phone").alias("work_phone"),
        "latitude", "longitude",
        text.text_or_blank("referral_source").alias("referral_source"),
        "last_verified_date",
        "referral_count",
    )


def date_column(df: DataFrame, index: str | None = None) -> str | None:
    """The date a window applies to: the table's index if that is the intake date, else the referral date, else the intake date."""
    intake, referral = ("date_of_intake", "Date of Intake"), ("referral_date", "Referral Date")
    if index in intake and index in df.columns:
        return index
    return next((c for c in (*referral, *intake) if c in df.columns), None)


def largest_first(counts: DataFrame, count_name: str = "referral_count") -> DataFrame:
    """output order, by falling count, then by the other columns."""
    return counts.orderBy(F.col(count_name).desc(), *[F.col(f"`{c}`").asc_nulls_last() for c in counts.columns if c != count_name])


def window(df: DataFrame, start, end, date_col: str) -> DataFrame:
    """Inclusive window, applied only when both ends are given."""
    if start is None or end is None:
        return df
    lo = F.lit(str(start)).cast("timestamp_ntz")
    hi = F.lit(str(end)).cast("timestamp_ntz")
    return df.filter(F.col(date_col).between(lo, hi))


def referral_counts(referrals: DataFrame, start=None, end=None,
                    keys=("full_name", "work_address", "work_phone", "latitude", "longitude"),
                    date_col: str | None = None, count_name: str = "referral_count") -> DataFrame:
    """Referrals per provider key inside an optional date window.

    Rows with a null in any key are not counted (Q2) — a provider with two
    phones yields two rows.  Without ``date_col`` the window applies to ``date_column``.
    """
    date_col = date_col or date_column(referrals)
    df = window(referrals, start, end, date_col) if date_col else referrals
    keys = [k for k in keys if k in df.columns]
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else (cond & c)
    if cond is not None:
        df = df.filter(cond)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count_name))


def inbound_counts(inbound: DataFrame, start=None, end=None, date_col: str | None = None) -> DataFrame:
    """D3: inbound referrals per provider key; ``full_address`` = work address."""
    keys = ("full_name", "street", "city", "state", "zip", "latitude", "longitude", "work_address", "work_phone")
    counts = referral_counts(inbound, start, end, keys, date_col, "inbound_referral_count")
    if "work_address" in counts.columns:
        counts = counts.withColumn("full_address", F.col("work_address"))
    return counts


def raw_inbound_counts(raw: DataFrame, start=None, end=None, date_col: str = "Date of Intake") -> DataFrame:
    """Counts straight from a raw export — primary and secondary referred-from parties.

    Absent secondary columns become null (those rows then fall out of the
    null-key rule) instead of failing.
    """
    parts = {
        "full_name": ("Referred From Full Name", "Secondary Referred From Full Name"),
        "street": ("Referred From Address 1 Line 1", "Secondary Referred From Address 1 Line 1"),
        "city": ("Referred From Address 1 City", "Secondary Referred From Address 1 City"),
        "state": ("Referred From Address 1 State", "Secondary Referred From Address 1 State"),
        "zip": ("Referred From Address 1 Zip", "Secondary Referred From Address 1 Zip"),
        "latitude": ("Referred From's Details: Latitude", "Secondary Referred From's Details: Latitude"),
        "longitude": ("Referred From's Details: Longitude", "Secondary Referred From's Details: Longitude"),
    }
    df = raw
    if date_col in raw.columns and start is not None and end is not None:
        # Export dates are text (ISO or Excel serial): normalise before comparing.
        df = raw.withColumn("_d", time.normalize_date(date_col))
        df = window(df, start, end, "_d")
    primary_keys = [k for k, (p, _) in parts.items() if p in df.columns]

    def side(i: int) -> Column:
        return F.struct(*[(F.col(f"`{parts[k][i]}`") if parts[k][i] in df.columns
                           else F.lit(None).cast("string")).cast("string").alias(k) for k in primary_keys])

    both = df.select(F.inline(F.array(side(0), side(1)))).filter(F.col("full_name").isNotNull())
    counts = referral_counts(both, None, None, primary_keys, date_col, "inbound_referral_count")
    if all(k in counts.columns for k in ("street", "city", "state", "zip")):
        counts = counts.withColumn("full_address", text.naive_full_address("street", "city", "state", "zip"))
    return counts


def unique_specialties(providers: DataFrame, col: str = "specialty") -> DataFrame:
    """Distinct trimmed comma-separated specialties, sorted."""
    parts = providers.select(F.explode(F.split(F.col(col), ",")).alias("s"))
    return (parts.select(F.trim("s").alias("specialty")).filter(F.col("specialty") != "")
            .distinct().orderBy("specialty"))
