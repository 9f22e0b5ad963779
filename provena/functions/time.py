"""Date normalisation and freshness expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from provena.functions.common import try_cast

from provena.schema import EXCEL_EPOCH, MIN_PLAUSIBLE_DATE

# A cell is an Excel serial when it is plain decimal text.
_NUMERIC = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"

# Text layouts accepted besides ISO-8601 (which the cast handles).
_LAYOUTS = ["M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy", "yyyy/M/d"]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def excel_serial_to_ts(days: Column) -> Column:
    """Fractional days since 1899-12-30 → naive timestamp (µs precision)."""
    micros = F.round(days * F.lit(86400000000.0)).cast("bigint")
    return F.timestamp_add("MICROSECOND", micros, F.lit(EXCEL_EPOCH).cast("timestamp_ntz"))


def normalize_date(name: str) -> Column:
    """Mixed ISO text / Excel serial / other layouts → ``timestamp_ntz`` for column ``name``.

    Plain decimal text is an Excel serial and is tested *before* the
    timestamp cast, because Spark would read "45500" as the year 45500.
    Built as one SQL expression: it runs on several columns of every
    export, and one parsed expression is much cheaper to construct than a
    tree of Column calls.
    """
    ref = name if name.startswith("`") else f"`{name}`"
    s = f"trim(CAST({ref} AS STRING))"
    layouts = ", ".join(f"CAST(try_to_timestamp({s}, '{fmt}') AS TIMESTAMP_NTZ)" for fmt in _LAYOUTS)
    numeric = _NUMERIC.replace("\\", "\\\\")
    return F.expr(
        f"CASE WHEN {ref} IS NULL OR {s} = '' THEN CAST(NULL AS TIMESTAMP_NTZ) "
        f"WHEN {s} RLIKE '{numeric}' THEN timestampadd(MICROSECOND, "
        f"CAST(round(try_cast({s} AS DOUBLE) * 86400000000.0) AS BIGINT), TIMESTAMP_NTZ'{EXCEL_EPOCH}') "
        f"ELSE coalesce(try_cast({s} AS TIMESTAMP_NTZ), {layouts}) END")


def normalize_date_typed(name: str, data_type) -> Column:
    """``normalize_date`` that respects an already-typed column."""
    from pyspark.sql import types as T
    c = F.col(name if name.startswith("`") else f"`{name}`")
    if isinstance(data_type, (T.TimestampNTZType,)):
        return c
    if isinstance(data_type, (T.TimestampType, T.DateType)):
        return c.cast("timestamp_ntz")
    if isinstance(data_type, T.NumericType):
        return excel_serial_to_ts(c.cast("double"))
    return normalize_date(name)


def plausible_date(c) -> Column:
    """Dates before 1990-01-01 are treated as missing."""
    c = _c(c)
    return F.when(c < F.lit(MIN_PLAUSIBLE_DATE).cast("timestamp_ntz"),
                  F.lit(None).cast("timestamp_ntz")).otherwise(c)


def age_days(c, as_of) -> Column:
    """Whole days elapsed from ``c`` to ``as_of``, floored, never negative."""
    c = _c(c)
    as_of = F.lit(as_of).cast("timestamp_ntz") if isinstance(as_of, str) else as_of
    secs = F.timestamp_diff("SECOND", c, as_of)
    return F.when(c.isNull(), F.lit(None).cast("bigint")).otherwise(
        F.greatest(F.lit(0).cast("bigint"), F.floor(secs / F.lit(86400)).cast("bigint")))


# FIXED VALUES: freshness marks and labels.
FRESH, STALE, VERY_STALE, UNKNOWN = "Fresh", "Stale", "Very Stale", "Unknown"
MARKS = {FRESH: "✅", STALE: "⚠️", VERY_STALE: "❌", UNKNOWN: "❓"}


def freshness_status(c, as_of, stale_days: int = 90, very_stale_days: int = 180) -> Column:
    a = age_days(c, as_of)
    return (F.when(a.isNull(), F.lit(UNKNOWN))
            .when(a <= stale_days, F.lit(FRESH))
            .when(a <= very_stale_days, F.lit(STALE))
            .otherwise(F.lit(VERY_STALE)))


def freshness_mark(c, as_of, stale_days: int = 90, very_stale_days: int = 180) -> Column:
    st = freshness_status(c, as_of, stale_days, very_stale_days)
    m = F.create_map(*[F.lit(x) for kv in MARKS.items() for x in kv])
    return F.element_at(m, st)


def freshness_display(c, as_of, stale_days: int = 90, very_stale_days: int = 180,
                      include_age: bool = True, include_mark: bool = True) -> Column:
    """``<mark> yyyy-MM-dd (n days ago)``; null → ``Not Available``."""
    c = _c(c)
    parts = []
    if include_mark:
        parts.append(freshness_mark(c, as_of, stale_days, very_stale_days))
    parts.append(F.date_format(c, "yyyy-MM-dd"))
    if include_age:
        parts.append(F.concat(F.lit("("), age_days(c, as_of).cast("string"), F.lit(" days ago)")))
    return F.when(c.isNull(), F.lit("Not Available")).otherwise(F.concat_ws(" ", *parts))
