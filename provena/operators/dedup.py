"""Order-sensitive keep-first (E1) and whole-row distinct.

``row_number() = 1`` over ``partitionBy(key)`` is planned with a
``WindowGroupLimit`` that keeps one row per key in every map partition
*before* the shuffle, so a hot key (even one holding a third of the rows)
ships at most one row per partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order_cols(order: list) -> list[Column]:
    return [F.col(o).asc_nulls_last() if isinstance(o, str) else o for o in order]


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First row per ``keys`` by ``order`` (null keys form one group)."""
    w = Window.partitionBy(*keys).orderBy(*_order_cols(order))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def distinct_rows(df: DataFrame, exclude: tuple[str, ...] = ("_seq",)) -> DataFrame:
    """Whole-row distinct ignoring bookkeeping columns (keeps the first ``_seq``)."""
    cols = [c for c in df.columns if c not in exclude]
    if "_seq" in df.columns:
        return df.groupBy(*cols).agg(F.min("_seq").alias("_seq"))
    return df.dropDuplicates(cols)
