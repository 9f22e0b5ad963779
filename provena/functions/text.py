"""Text cleaning expressions (phones, addresses, states, address keys).

Every helper returns a native ``Column`` so that Catalyst can fold it into
whole-stage codegen; nothing here runs Python per row.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from provena.functions.common import try_cast

from provena.schema import MISSING_TOKENS, STATE_CODES


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_if_blank(c) -> Column:
    """Null when the cell is null, blank, or one of the missing tokens."""
    c = _c(c)
    t = F.trim(c)
    return F.when(c.isNull() | t.isin(*MISSING_TOKENS), F.lit(None).cast("string")).otherwise(c)


def blank_if_missing(c) -> Column:
    """Trimmed text with missing tokens mapped to ``""`` (address parts)."""
    c = _c(c)
    t = F.trim(c.cast("string"))
    return F.when(c.isNull() | t.isin(*MISSING_TOKENS), F.lit("")).otherwise(t)


def text_or_blank(c) -> Column:
    """Untrimmed text, missing tokens (exact match) mapped to ``""``."""
    c = _c(c).cast("string")
    return F.when(c.isNull() | c.isin(*MISSING_TOKENS), F.lit("")).otherwise(c)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def _us_format(d: Column) -> Column:
    return F.concat(F.lit("("), F.substring(d, 1, 3), F.lit(") "),
                    F.substring(d, 4, 3), F.lit("-"), F.substring(d, 7, 4))


def clean_phone(c) -> Column:
    """Ten digits → ``(ddd) ddd-dddd``; otherwise the trimmed text; blank → null."""
    c = _c(c)
    d = _digits(c)
    trimmed = F.trim(c)
    return (F.when(c.isNull(), F.lit(None).cast("string"))
            .when(F.length(d) == 10, _us_format(d))
            .when(trimmed == "", F.lit(None).cast("string"))
            .otherwise(trimmed))


def format_phone(c) -> Column:
    """Display phone: strips a float tail (``4435140560.0``), accepts a leading 1.

    Anything that cannot be formatted is returned as it was (after the float
    tail was removed, when that parse succeeded).
    """
    c = _c(c).cast("string")
    as_num = try_cast(c, "double")
    finite = as_num.isNotNull() & ~F.isnan(as_num) & (F.abs(as_num) < F.lit(9.2e18))
    base = F.when(F.instr(c, ".") > 0,
                  F.when(finite, try_cast(as_num, "bigint").cast("string")).otherwise(c)
                  ).otherwise(c)
    d = _digits(base)
    return (F.when(c.isNull(), F.lit(None).cast("string"))
            .when(F.length(d) == 10, _us_format(d))
            .when((F.length(d) == 11) & d.startswith("1"), _us_format(F.substring(d, 2, 10)))
            .otherwise(base))


def strip_phone(c) -> Column:
    """Notebook variant: remove ``- ( )`` and spaces; format when 10 digits."""
    c = _c(c)
    s = F.regexp_replace(c.cast("string"), r"[-() ]", "")
    return (F.when(c.isNull(), F.lit(None).cast("string"))
            .when(s.rlike(r"^[0-9]{10}$"), _us_format(s))
            .otherwise(s))


def clean_address(c) -> Column:
    """Trim, blank → null, collapse ``", ,"`` and double spaces (one literal pass each)."""
    c = _c(c)
    t = F.trim(c)
    fixed = F.replace(F.replace(t, F.lit(", ,"), F.lit(",")), F.lit("  "), F.lit(" "))
    return F.when(c.isNull() | (t == ""), F.lit(None).cast("string")).otherwise(fixed)


def tidy_commas(c) -> Column:
    """Collapse ``, ,`` runs and drop a trailing comma."""
    return F.regexp_replace(F.regexp_replace(_c(c), r",\s*,", ","), r",\s*$", "")


def naive_full_address(street, city, state, zip_) -> Column:
    """``street, city, state zip`` with comma clean-up (missing parts → "")."""
    parts = [text_or_blank(p) for p in (street, city, state, zip_)]
    s = F.concat(parts[0], F.lit(", "), parts[1], F.lit(", "), parts[2], F.lit(" "), parts[3])
    return tidy_commas(s)


def build_full_address(full, work, street, city, state, zip_) -> Column:
    """Keep a non-blank full address, else the work address, else the parts joined by ``", "``."""
    def strip_or_null(c):
        if c is None:
            return F.lit(None).cast("string")
        return null_if_blank(F.trim(_c(c).cast("string")))
    parts = [F.when(F.trim(_c(p)) != "", F.trim(_c(p))) for p in (street, city, state, zip_) if p is not None]
    constructed = F.concat_ws(", ", *parts) if parts else F.lit("")
    out = F.coalesce(strip_or_null(full), strip_or_null(work), constructed)
    return tidy_commas(out)


def _state_map() -> Column:
    """State lookup: a 51-entry literal map, evaluated in codegen (no join needed)."""
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(STATE_CODES.items())])


def state_code(c) -> Column:
    """Full upper-case state name → postal code; anything else unchanged."""
    c = _c(c)
    return F.coalesce(F.try_element_at(_state_map(), F.upper(c)), c)


def address_key(c) -> Column:
    """md5 of the lower-cased trimmed address; blank → null."""
    c = _c(c)
    t = F.trim(c)
    return F.when(c.isNull() | (t == ""), F.lit(None).cast("string")).otherwise(F.md5(F.lower(t)))


def search_address(street, city, state, zip_) -> Column:
    """One-line search address: ``street, city, state zip`` without edge commas/spaces."""
    s = F.concat(F.coalesce(_c(street), F.lit("")), F.lit(", "), F.coalesce(_c(city), F.lit("")),
                 F.lit(", "), F.coalesce(_c(state), F.lit("")), F.lit(" "), F.coalesce(_c(zip_), F.lit("")))
    return F.regexp_replace(s, r"^[, ]+|[, ]+$", "")
