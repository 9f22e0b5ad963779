"""Provider enrichment (I3/I4/I5): coordinates, addresses, phones, inbound
counts, the preferred list, and windowed re-counting.

Joins are on the provider name with null-safe equality (a null name on
both sides matches, as the application's table merge does).  The count
tables have at most one row per (name, address, phone, coordinates) and
are shuffled or broadcast by AQE according to their measured size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.functions import geo, text
from provena.operators import rollup
from provena.operators.dedup import keep_first


def valid_coordinates(providers: DataFrame) -> DataFrame:
    """I3 tail (H12 + B17): coordinates → double (bad/missing → 0), then drop zeros."""
    types = {f.name: f.dataType for f in providers.schema.fields}
    return (providers
            .withColumns({"latitude": geo.safe_double("latitude", 0.0, types.get("latitude")),
                          "longitude": geo.safe_double("longitude", 0.0, types.get("longitude"))})
            .filter((F.col("latitude") != 0) & (F.col("longitude") != 0)))


def clean_address_parts(df: DataFrame) -> DataFrame:
    """Trim parts, missing tokens → "", state names → postal codes."""
    out = {c: text.blank_if_missing(c) for c in ("street", "city", "state", "zip") if c in df.columns}
    df = df.withColumns(out) if out else df
    if "state" in df.columns:
        df = df.withColumn("state", text.state_code("state"))
    return df


def with_full_address(df: DataFrame) -> DataFrame:
    """H9: full address from the existing value, the work address, or the parts."""
    def opt(c):
        return c if c in df.columns else None
    return df.withColumn("full_address", text.build_full_address(
        opt("full_address"), opt("work_address"), opt("street"), opt("city"), opt("state"), opt("zip")))


def with_display_phone(df: DataFrame) -> DataFrame:
    """H2: ``work_phone_number`` from the first phone column present."""
    for src in ("work_phone_number", "work_phone", "phone_number", "phone_1"):
        if src in df.columns:
            return df.withColumn("work_phone_number", text.format_phone(src))
    return df


def attach_inbound_counts(providers: DataFrame, inbound_counts: DataFrame, collapse_counts: bool = False) -> DataFrame:
    """LEFT JOIN counts on name (null-safe), missing → 0.

    Count rows are per (name, address, phone, coordinates), so a provider
    with several such rows fans out — the application's behaviour (Q3).
    ``collapse_counts=True`` sums them per name first (one row per provider).
    """
    if collapse_counts:
        inbound_counts = inbound_counts.groupBy("full_name").agg(
            F.sum("inbound_referral_count").alias("inbound_referral_count"))
    counts = inbound_counts.select(F.col("full_name").alias("_in_name"), "inbound_referral_count")
    j = providers.join(counts, providers.full_name.eqNullSafe(counts._in_name), "left").drop("_in_name")
    return j.withColumn("inbound_referral_count",
                        F.coalesce(F.col("inbound_referral_count"), F.lit(0)).cast("bigint"))


def attach_preferred(providers: DataFrame, preferred: DataFrame | None) -> DataFrame:
    """FULL OUTER JOIN with the first row per name of the preferred list.

    ``preferred`` is true for names on the list (including names only on the
    list); the list's specialty replaces the provider's.
    """
    if preferred is None:
        return providers.withColumn("preferred", F.lit(False))
    pref_cols = ["full_name"] + (["specialty"] if "specialty" in preferred.columns else [])
    order = ["_seq"] if "_seq" in preferred.columns else [F.lit(0)]
    pref = keep_first(preferred.select(*pref_cols, *(["_seq"] if "_seq" in preferred.columns else [])),
                      ["full_name"], order)
    pref = pref.select(F.col("full_name").alias("_p_name"),
                       *( [F.col("specialty").alias("_p_specialty")] if "specialty" in pref_cols else []),
                       F.lit(True).alias("_on_list"))
    base = providers.drop("specialty") if "specialty" in pref_cols and "specialty" in providers.columns else providers
    j = base.withColumn("_on_left", F.lit(True)).join(pref, base.full_name.eqNullSafe(pref._p_name), "full_outer")
    out = j.withColumn("full_name", F.when(F.col("_on_left"), F.col("full_name")).otherwise(F.col("_p_name")))
    out = out.withColumn("preferred", F.coalesce(F.col("_on_list"), F.lit(False)))
    if "specialty" in pref_cols:
        out = out.withColumn("specialty", F.col("_p_specialty"))
    return out.drop("_p_name", "_p_specialty", "_on_list", "_on_left")


def enrich_providers(providers: DataFrame, inbound: DataFrame | None, preferred: DataFrame | None,
                     collapse_counts: bool = False) -> DataFrame:
    """I4: the application's provider table.

    providers → valid coordinates → address parts → full address → first row
    per name → display phone → inbound counts → preferred list → counts as
    numbers with 0 for missing.
    """
    df = valid_coordinates(providers)
    df = clean_address_parts(df)
    df = with_full_address(df)
    if "_seq" in df.columns:
        # First row per name.  A roll-up output is already one row per
        # name, so without an input order there is nothing to choose.
        df = keep_first(df, ["full_name"], ["_seq"])
    df = with_display_phone(df)
    if inbound is not None:
        df = attach_inbound_counts(df, rollup.inbound_counts(inbound), collapse_counts)
    df = attach_preferred(df, preferred)
    df = df.withColumn("referral_count",
                       F.coalesce(F.col("referral_count").try_cast("bigint"), F.lit(0)).cast("bigint"))
    if "inbound_referral_count" in df.columns:
        df = df.withColumn("inbound_referral_count", F.coalesce(F.col("inbound_referral_count"), F.lit(0)).cast("bigint"))
    else:
        df = df.withColumn("inbound_referral_count", F.lit(0).cast("bigint"))
    return df


def apply_time_filtering(providers: DataFrame, outbound: DataFrame, inbound: DataFrame | None,
                         start, end) -> DataFrame:
    """Replace both counts with counts inside ``[start, end]``.

    When the window holds no referrals at all the old counts stay (the
    application's rule, Q5).  The "window is empty" test is a scalar
    subquery folded into the plan, not a driver-side ``isEmpty()``.
    """
    def swap(df: DataFrame, counts: DataFrame, col: str) -> DataFrame:
        c = counts.select(F.col("full_name").alias("_w_name"), F.col(col).alias("_w_cnt"))
        any_rows = counts.select(F.count(F.lit(1)) > 0).scalar()
        j = df.join(c, df.full_name.eqNullSafe(c._w_name), "left").drop("_w_name")
        new = F.when(any_rows, F.coalesce(F.col("_w_cnt"), F.lit(0)).cast("bigint")).otherwise(F.col(col))
        return j.withColumn(col, new).drop("_w_cnt")

    out = swap(providers, rollup.referral_counts(outbound, start, end), "referral_count")
    if inbound is not None:
        out = swap(out, rollup.inbound_counts(inbound, start, end), "inbound_referral_count")
    return out
