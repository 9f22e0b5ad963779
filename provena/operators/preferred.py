"""Preferred-provider list (I2): de-duplicate, split off rows without
coordinates, map export headers to canonical columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena import schema as S
from provena.functions import geo, time
from provena.operators.dedup import distinct_rows, keep_first

PERSON_ID = "Contact's Details: Person ID"
LAT, LON = "Contact's Details: Latitude", "Contact's Details: Longitude"


def dedup_preferred(raw: DataFrame) -> DataFrame:
    """First row per Person ID when that column exists, else whole-row distinct."""
    if PERSON_ID in raw.columns:
        order = ["_seq"] if "_seq" in raw.columns else [F.monotonically_increasing_id()]
        return keep_first(raw, [PERSON_ID], order)
    return distinct_rows(raw)


def canonical_preferred(df: DataFrame) -> DataFrame:
    """Export headers → canonical columns (coordinates as doubles, dates normalised)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = []
    for src, tgt in S.PREFERRED_CONTACT.items():
        if src not in df.columns:
            continue
        c = F.col(f"`{src}`")
        if tgt in ("latitude", "longitude"):
            c = geo.nan_to_null(c.cast("string").try_cast("double"))
        elif tgt == "last_verified_date":
            c = time.plausible_date(time.normalize_date_typed(src, types[src]))
        cols.append(c.alias(tgt))
    if "_seq" in df.columns:
        cols.append(F.col("_seq"))
    return df.select(*cols)


def process_preferred(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(cleaned, missing_geo)`` — both lazy; no driver round trips."""
    canon = canonical_preferred(dedup_preferred(raw))
    if {"latitude", "longitude"}.issubset(canon.columns):
        has_geo = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
        return canon.filter(has_geo), canon.filter(~has_geo)
    return canon, canon.limit(0)


def preferred_summary(raw: DataFrame) -> DataFrame:
    """D15 + D17: totals, cleaned/missing-geo counts, distinct names and the size alarm.

    One aggregate over the de-duplicated list; the raw total is a scalar subquery.
    """
    deduped = canonical_preferred(dedup_preferred(raw))
    has_geo = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    total = raw.select(F.count(F.lit(1))).scalar()
    stats = deduped.agg(F.count_if(has_geo).alias("cleaned_count"),
                        F.count_if(~has_geo).alias("missing_geo_count"),
                        F.count_distinct("full_name").alias("distinct_names"))
    return stats.select(total.alias("total_count"), "cleaned_count", "missing_geo_count", "distinct_names",
                        (F.col("distinct_names") > 100).alias("too_many_preferred"))
