"""Loading a dataset by name (A5): from an export, from one that is clean already (B10), or from the cleaned tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena import schema as S
from provena.operators import preferred, referrals as R, rollup
from provena.session import cut_lineage
from provena.sources import io
from provena.sources.keyed import path_exists

INBOUND, OUTBOUND, ALL, PREFERRED, PROVIDERS = "inbound_referrals", "outbound_referrals", "all_referrals", "preferred_providers", "provider_data"
DATASETS = (INBOUND, OUTBOUND, ALL, PREFERRED, PROVIDERS)
_TYPES = {INBOUND: ["inbound"], OUTBOUND: ["outbound"], ALL: ["inbound", "outbound"], PROVIDERS: ["outbound"]}


def save_cleaned(referrals: DataFrame, preferred_rows: DataFrame, cleaned: str) -> None:
    """The tables that ``load_dataset`` falls back to."""
    io.write_referrals(referrals, f"{cleaned}/referrals")
    io.write_table(preferred_rows, f"{cleaned}/preferred")


def _exported(load: Callable[[], DataFrame] | None) -> DataFrame | None:
    """The export, or None if there is none to read (a missing folder fails when the frame is made)."""
    try:
        return load() if load else None
    except AnalysisException:
        return None


def _referrals(spark: SparkSession, name: str, export: DataFrame | None, cleaned: str) -> DataFrame:
    types = _TYPES[name]
    if export is None:
        path = f"{cleaned}/referrals"
        rows = spark.read.parquet(path) if path_exists(spark, path) else spark.createDataFrame([], S.REFERRALS_SCHEMA)
    elif R.is_cleaned(export):
        rows = export
    else:
        return R.process_referrals(export, referral_types=types)
    # Clean rows pass through with whatever columns they have.
    return rows.filter(F.col("referral_type").isin(types)) if "referral_type" in rows.columns else rows


def load_dataset(spark: SparkSession, name: str, export: Callable[[], DataFrame] | None, cleaned: str) -> DataFrame:
    """One of ``DATASETS`` as a lazy DataFrame.

    ``export`` gives the export (raw or clean already); without one, or if it can't be read, the tables in ``cleaned`` are
    used, and if there are none either, the dataset is empty.  Provider data is always rolled up from outbound rows.
    """
    if name not in DATASETS:
        raise ValueError(f"unknown dataset {name}; one of {', '.join(DATASETS)}")
    found = _exported(export)
    if name == PREFERRED:
        if found is None:
            path = f"{cleaned}/preferred"
            return spark.read.parquet(path) if path_exists(spark, path) else spark.createDataFrame([], "full_name string")
        return found if R.is_cleaned(found) else preferred.process_preferred(found)[0]
    rows = _referrals(spark, name, found, cleaned)
    if name != PROVIDERS:
        return rows
    return rollup.provider_rollup(rows if "_seq" in rows.columns else rows.withColumn("_seq", F.lit(0).cast("long")))


def load_datasets(spark: SparkSession, names: list[str], export: Callable[[], DataFrame] | None, cleaned: str) -> dict[str, DataFrame]:
    """Several datasets of referrals from the same export: a raw one is cleaned and written once, and every dataset takes its rows from that."""
    found = _exported(export)
    if found is not None and not R.is_cleaned(found):
        found = cut_lineage(R.process_referrals(found))
    return {name: load_dataset(spark, name, None if found is None else lambda: found, cleaned) for name in names}
