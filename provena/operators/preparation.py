"""Preparation with its summary taken on the write (D13), and validation of sources that may fail."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from provena import schema as S
from provena.operators import quality, referrals as R
from provena.session import cut_lineage
from provena.sources import io

SUMMARY_SCHEMA = "section string, name string, value long"
#: Issue checks of the cleaned tables: column, message (fixed values).
ISSUES = [("full_name", "Missing Full Name"), ("work_address", "Missing Work Address"), ("work_phone", "Missing Work Phone"),
          ("latitude", "Missing Latitude"), ("longitude", "Missing Longitude")]


def split_configs(raw: DataFrame, configs: list[R.ReferralConfig]) -> tuple[list[R.ReferralConfig], list[str]]:
    """Configs the export can serve, and the names of those none of whose columns it has."""
    present = set(raw.columns)
    usable = [c for c in configs if present & set(c.columns)]
    return usable, [c.name for c in configs if c not in usable]


def column_warnings(raw: DataFrame, configs: list[R.ReferralConfig]) -> list[str]:
    """One line per config that misses headers which aren't optional."""
    present = set(raw.columns)
    out = []
    for c in configs:
        missing = [h for h in c.columns if h not in present and h not in S.OPTIONAL_HEADERS]
        if missing:
            out.append(f"{c.name} missing columns: {', '.join(missing)}")
    return out


def _metrics() -> dict[tuple[str, str], Column]:
    kinds = {"inbound": F.col("referral_type") == "inbound", "outbound": F.col("referral_type") == "outbound", "all": F.lit(True)}
    out = {("rows", k): F.count_if(c) for k, c in kinds.items()}
    for column, reason in ISSUES:
        empty = F.col(column).isNull() | F.trim(F.col(column).cast("string")).isin(*S.MISSING_TOKENS)
        out |= {("issue", f"{k}: {reason}"): F.count_if(c & empty) for k, c in kinds.items()}
    return out


def prepare(raw: DataFrame, out_dir: str, configs: list[R.ReferralConfig] | None = None, dedup: str = "reference") -> DataFrame:
    """Write the cleaned referrals (A6) and return the summary ``(section, name, value)``.

    ``rows`` per output, ``issue`` counts above zero, ``skipped`` configs and ``warning`` lines.  The counts are observed
    while the rows are written, so the export is read for the write alone.  An export without any party's columns writes
    nothing but an empty table's folder.
    """
    spark = raw.sparkSession
    every = configs or R.default_configs()
    usable, skipped = split_configs(raw, every)
    cleaned = (R.process_referrals(raw, usable, dedup) if usable
               else spark.createDataFrame([], S.REFERRALS_SCHEMA).withColumn("_seq", F.lit(None).cast("long")))
    metrics = _metrics()
    seen = Observation()
    names = {f"m{i}": key for i, key in enumerate(metrics)}
    io.write_referrals(cleaned.observe(seen, *[c.alias(n) for n, c in zip(names, metrics.values())]), out_dir)
    values = {names[n]: v for n, v in seen.get.items()}
    rows = [(*key, values.get(key, 0)) for key in metrics if key[0] == "rows" or values.get(key)]
    rows += [("skipped", name, None) for name in skipped]
    rows += [("warning", line, None) for line in column_warnings(raw, every)]
    return spark.createDataFrame(rows, SUMMARY_SCHEMA)


def validate_sources(spark: SparkSession, sources: dict[str, tuple[Callable[[], DataFrame], list[str]]],
                     corrupt_col: str = "_corrupt") -> DataFrame:
    """D8's row for each source plus ``corrupt_rows`` and ``error``; a source that can't be read is an invalid row.

    A source is a function that gives its DataFrame.  Each is run by itself, since a failure must not take the others'
    rows along.  Lines that the reader marked in ``corrupt_col`` make a source invalid too.
    """
    parts = []
    for name, (load, required) in sources.items():
        try:
            df = load().drop("_seq")
            bad = F.count(F.col(corrupt_col)) if corrupt_col in df.columns else F.lit(0).cast("long")
            plain = [c for c in df.columns if c != corrupt_col]
            row = cut_lineage(quality.integrity(df, name, required, columns=plain, extra=[bad.alias("corrupt_rows")])
                              .withColumns({"valid": F.col("valid") & (F.col("corrupt_rows") == 0), "error": F.lit(None).cast("string")}))
            parts.append(row)
        except (PySparkException, Py4JJavaError) as e:  # the latter where no Python class stands for the JVM's
            reason = (e.getCondition() if isinstance(e, PySparkException) else None) or type(e).__name__
            parts.append(spark.createDataFrame([(name, False, 0, 0, ", ".join(required), 0, 0, 0.0, 0, reason)], VALIDATION_SCHEMA))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


VALIDATION_SCHEMA = ("dataset string, valid boolean, row_count long, column_count int, missing_required_columns string, duplicate_names long, "
                     "invalid_coordinates long, missing_values_pct double, corrupt_rows long, error string")
