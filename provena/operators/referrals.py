"""Wide referral export → long, cleaned referral table.

One raw row describes up to three referrals (primary referred-from,
secondary referred-from, referred-to).  ``split_referrals`` turns them into
long rows in a single scan: an array of per-party structs is built, each
party's own predicates are evaluated inside the array, and the survivors
are exploded.  Cleaning is per-row native expressions; the only shuffle is
the optional Person-ID keep-first.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.functions.common import try_cast

from provena import schema as S
from provena.functions import geo, text, time
from provena.operators.dedup import keep_first

Predicate = Callable[[Column], Column]


@dataclass
class ReferralConfig:
    """One party of the wide export: header→column map, predicates, tag."""

    name: str
    columns: dict[str, str]
    referral_type: str
    # Predicates see the *selected, uncleaned* struct and must all hold.
    predicates: list[Predicate] = field(default_factory=list)
    default_source: str | None = None


def _notnull(name: str) -> Predicate:
    return lambda r: r[name].isNotNull()


def _inbound_predicates() -> list[Predicate]:
    return [lambda r: r["referral_source"] == S.DOCTOR_OFFICE_SOURCE,
            _notnull("full_name"), _notnull("work_address"), _notnull("latitude"), _notnull("longitude")]


def default_configs(require_geo: bool = True) -> list[ReferralConfig]:
    """The three parties of the export (primary/secondary inbound, outbound)."""
    inbound = _inbound_predicates() if require_geo else _inbound_predicates()[:3]
    outbound = ([_notnull("full_name"), _notnull("latitude"), _notnull("longitude")]
                if require_geo else [_notnull("full_name")])
    return [
        ReferralConfig("primary_inbound", S.PRIMARY_FROM, "inbound", inbound, S.DOCTOR_OFFICE_SOURCE),
        ReferralConfig("secondary_inbound", S.SECONDARY_FROM, "inbound", inbound, S.DOCTOR_OFFICE_SOURCE),
        ReferralConfig("outbound", S.REFERRED_TO, "outbound", outbound, S.OUTBOUND_SOURCE),
    ]


_PARTY_FIELDS = ["referral_source", "full_name", "work_phone", "work_address",
                 "latitude", "longitude", "last_verified_date", "person_id"]


def missing_columns(raw: DataFrame, configs: list[ReferralConfig] | None = None) -> DataFrame:
    """Plan-time schema report: ``(config, column, required)`` for absent headers (B2)."""
    configs = configs or default_configs()
    present = set(raw.columns)
    rows = []
    for cfg in configs:
        for src in [S.RAW_PROJECT_ID, S.RAW_INTAKE, *cfg.columns]:
            if src not in present:
                rows.append((cfg.name, src, src not in S.OPTIONAL_HEADERS))
    schema = "config string, column string, required boolean"
    return raw.sparkSession.createDataFrame(rows, schema)


def normalize_raw(raw: DataFrame) -> DataFrame:
    """Intake / create / verified dates → ``timestamp_ntz``; intake falls back to create."""
    types = {f.name: f.dataType for f in raw.schema.fields}
    out = {}
    intake = (time.normalize_date_typed(S.RAW_INTAKE, types[S.RAW_INTAKE])
              if S.RAW_INTAKE in types else F.lit(None).cast("timestamp_ntz"))
    if S.RAW_CREATE in types:
        intake = F.coalesce(intake, time.normalize_date_typed(S.RAW_CREATE, types[S.RAW_CREATE]))
    out[S.RAW_INTAKE] = intake
    for h in S.RAW_VERIFIED_HEADERS:
        if h in types:
            out[h] = time.normalize_date_typed(h, types[h])
    return raw.withColumns(out)


def _party_struct(raw: DataFrame, cfg: ReferralConfig) -> Column:
    present = set(raw.columns)
    fields = []
    for tgt in _PARTY_FIELDS:
        src = next((s for s, t in cfg.columns.items() if t == tgt), None)
        if src is not None and src in present:
            c = F.col(f"`{src}`")
            c = c if tgt == "last_verified_date" else c.cast("string")
        else:
            c = F.lit(None).cast("timestamp_ntz" if tgt == "last_verified_date" else "string")
        fields.append(c.alias(tgt))
    return F.struct(*fields)


def split_referrals(raw: DataFrame, configs: list[ReferralConfig] | None = None,
                    only: list[int] | None = None) -> DataFrame:
    """One scan, explode surviving parties; cleaned long rows (H1/H4/H5).

    ``only`` restricts the split to some parties (indices into ``configs``,
    kept as ``_cfg``); the other parties' columns are then never read.
    """
    configs = configs or default_configs()
    only = list(range(len(configs))) if only is None else only
    norm = normalize_raw(raw)
    pid = (try_cast(F.col(f"`{S.RAW_PROJECT_ID}`").cast("string"), "bigint")
           if S.RAW_PROJECT_ID in raw.columns else F.lit(None).cast("bigint"))
    seq = F.col("_seq") if "_seq" in raw.columns else F.monotonically_increasing_id()
    parties = []
    for i, cfg in enumerate(configs):
        if i not in only:
            continue
        st = _party_struct(norm, cfg)
        keep = functools.reduce(lambda a, b: a & b, [p(st) for p in cfg.predicates], F.lit(True))
        tagged = st.withField("_cfg", F.lit(i)).withField("_keep", F.coalesce(keep, F.lit(False)))
        parties.append(tagged)
    # Explode all parties, then filter: Generate and Filter stay in codegen
    # (a lambda ``filter`` over the array would be interpreted per row).
    exploded = norm.select(
        pid.alias("project_id"),
        F.col(f"`{S.RAW_INTAKE}`").alias("date_of_intake"),
        seq.alias("_seq"),
        F.explode(F.array(*parties)).alias("p"),
    ).filter(F.col("p._keep"))
    src_default = F.element_at(F.array(*[F.lit(c.default_source) for c in configs]), F.col("p._cfg") + 1)
    rtype = F.element_at(F.array(*[F.lit(c.referral_type) for c in configs]), F.col("p._cfg") + 1)
    return exploded.select(
        "project_id", "date_of_intake",
        F.coalesce(F.col("p.referral_source"), src_default).alias("referral_source"),
        F.col("p.full_name").alias("full_name"),
        text.clean_phone(F.col("p.work_phone")).alias("work_phone"),
        text.clean_address(F.col("p.work_address")).alias("work_address"),
        geo.clean_geocode(F.col("p.latitude")).alias("latitude"),
        geo.clean_geocode(F.col("p.longitude")).alias("longitude"),
        F.col("p.last_verified_date").alias("last_verified_date"),
        F.col("p.person_id").alias("person_id"),
        rtype.alias("referral_type"),
        F.col("p._cfg").alias("_cfg"),
        "_seq",
    )


def dedup_person_ids(long: DataFrame, configs: list[ReferralConfig] | None = None,
                     mode: str = "reference", only: list[int] | None = None) -> DataFrame:
    """Per party (``only``: those that ``long`` has), keep the first row per Person ID when that party has any ID.

    ``reference``: null IDs form one group (so all null-ID rows collapse to
    one) — what the exports' consumers expect.  ``keep_null_ids``: rows
    without an ID are all kept.  ``none``: no de-duplication.
    The "has any ID" gate looks for one such row per party before planning (it
    stops at the first, reading one column), so the plan scans the export
    once; for a stream it is a scalar subquery in the plan.
    """
    configs = configs or default_configs()
    if mode == "none":
        return long
    id_cfgs = [i for i, c in enumerate(configs) if "person_id" in c.columns.values() and (only is None or i in only)]
    if not id_cfgs:
        return long
    if long.isStreaming:
        gates = long.groupBy().agg(*[
            F.max(F.when((F.col("_cfg") == i) & F.col("person_id").isNotNull(), F.lit(True)).otherwise(F.lit(False))).alias(f"g{i}")
            for i in id_cfgs]).select(F.array(*[F.col(f"g{i}") for i in id_cfgs]).alias("g")).scalar()
        gate = F.coalesce(F.element_at(gates, F.array_position(F.array(*[F.lit(i) for i in id_cfgs]), F.col("_cfg")).cast("int")),
                          F.lit(False))
        deduped = F.col("_cfg").isin(*id_cfgs) & gate
        parts = [long.filter(~deduped)]
    else:
        active = [i for i in id_cfgs if not long.filter((F.col("_cfg") == i) & F.col("person_id").isNotNull()).select("person_id").isEmpty()]
        if not active:
            return long
        deduped = F.col("_cfg").isin(*active)
        parts = [] if only is not None and set(only) <= set(active) else [long.filter(~deduped)]
    candidates = long.filter(deduped)
    if mode == "keep_null_ids":
        parts.append(candidates.filter(F.col("person_id").isNull()))
        candidates = candidates.filter(F.col("person_id").isNotNull())
    parts.append(keep_first(candidates, ["_cfg", "person_id"], ["_seq"]))
    return functools.reduce(DataFrame.unionByName, parts)


def _id_parties(raw: DataFrame, configs: list[ReferralConfig]) -> list[int]:
    """Parties whose Person-ID header is present in the export (plan-time)."""
    out = []
    for i, c in enumerate(configs):
        src = next((h for h, t in c.columns.items() if t == "person_id"), None)
        if src is not None and src in raw.columns:
            out.append(i)
    return out


def process_referrals(raw: DataFrame, configs: list[ReferralConfig] | None = None,
                      dedup: str = "reference", referral_types: list[str] | None = None) -> DataFrame:
    """The cleaned long referral table, ``_seq`` kept for keep-first.

    ``referral_types`` limits the output to inbound and/or outbound rows; only
    those parties are split, so the export's other columns are never read.
    Parties without a Person-ID header pass straight through; the ID-bearing
    parties go through the gated keep-first (a ``row_number() = 1`` that prunes
    before its shuffle).
    """
    configs = configs or default_configs()
    wanted = [i for i, c in enumerate(configs) if referral_types is None or c.referral_type in referral_types]
    with_ids = [i for i in _id_parties(raw, configs) if i in wanted] if dedup != "none" else []
    plain = [i for i in wanted if i not in with_ids]
    parts = []
    if plain:
        parts.append(split_referrals(raw, configs, plain))
    if with_ids:
        parts.append(dedup_person_ids(split_referrals(raw, configs, with_ids), configs, dedup, with_ids))
    if not parts:
        return raw.sparkSession.createDataFrame([], S.REFERRALS_SCHEMA).withColumn("_seq", F.lit(None).cast("long"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*S.REFERRAL_COLUMNS, "_seq")


def preparation_summary(referrals: DataFrame) -> DataFrame:
    """Inbound / outbound / all counts in one aggregate."""
    return referrals.agg(
        F.count_if(F.col("referral_type") == "inbound").alias("inbound_rows"),
        F.count_if(F.col("referral_type") == "outbound").alias("outbound_rows"),
        F.count(F.lit(1)).alias("all_rows"),
    )


# Columns whose presence marks an export as already cleaned (B10): ours and the export's own headers.
CLEANED_MARKERS = [("full_name", "Full Name"), ("work_address", "Work Address"), ("work_phone", "Work Phone"),
                   ("latitude", "Latitude"), ("longitude", "Longitude"), ("referral_type", "referral_type")]


def is_cleaned(df: DataFrame) -> bool:
    """Plan-time check — at least 4 of the 6 canonical columns present."""
    return sum(any(c in df.columns for c in names) for names in CLEANED_MARKERS) >= 4
