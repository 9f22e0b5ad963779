"""Raw rows with one party laid over the canonical headers, all other columns kept (B8, B9), and their dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.functions import time
from provena.schema import OVERLAY_HEADERS, RAW_DATE_HEADERS, RAW_REFERRAL_DATE, RAW_VERIFIED

#: The party that each referral type describes, in output order.
PARTIES = {"outbound": "Referred To", "inbound": "Referred From"}


def _headers(party: str) -> dict[str, str]:
    """The party's header for each canonical one."""
    return {canonical: party + suffix for canonical, suffix in OVERLAY_HEADERS.items()}


def standardize_dates(df: DataFrame) -> DataFrame:
    """The export's date columns as timestamps, dates before 1990 null; ``Referral Date``, unless the export has
    one, is the first date *column* that exists (not the first value)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    present = [c for c in (*RAW_DATE_HEADERS, RAW_VERIFIED) if c in types]
    df = df.withColumns({c: time.plausible_date(time.normalize_date_typed(c, types[c])) for c in present})
    if RAW_REFERRAL_DATE not in types and (first := next((c for c in RAW_DATE_HEADERS if c in types), None)):
        df = df.withColumn(RAW_REFERRAL_DATE, F.col(f"`{first}`"))
    return df


def overlay(raw: DataFrame, referral_type: str) -> DataFrame:
    """The party's columns under the canonical headers, where the export names that party at all; type tagged."""
    headers = _headers(PARTIES[referral_type])
    present = set(raw.columns)
    if headers["Full Name"] in present:
        raw = raw.withColumns({c: F.col(f"`{h}`") for c, h in headers.items() if h in present})
    return standardize_dates(raw.withColumn("referral_type", F.lit(referral_type)))


def overlay_all(raw: DataFrame) -> DataFrame:
    """A row per party that a row names, the outbound one first, each with all columns of the row.

    ``_party`` (0 outbound, 1 inbound) gives the order within a row.  An export without either name header is returned as it is.
    """
    present = set(raw.columns)
    sides: list[Column] = []
    for i, (kind, party) in enumerate(PARTIES.items()):
        headers = _headers(party)
        if headers["Full Name"] in present:
            cells = [(F.col(f"`{h}`").cast("string") if h in present else F.lit(None).cast("string")).alias(c) for c, h in headers.items()]
            sides.append(F.struct(*cells, F.lit(kind).alias("referral_type"), F.lit(i).alias("_party")))
    if not sides:
        return standardize_dates(raw)
    rows = raw.drop(*OVERLAY_HEADERS, "referral_type", "_party").select("*", F.explode(F.array(*sides)).alias("_side"))
    rows = rows.filter(F.col("_side.`Full Name`").isNotNull())
    return standardize_dates(rows.select(*[f"`{c}`" for c in rows.columns if c != "_side"], "_side.*"))
