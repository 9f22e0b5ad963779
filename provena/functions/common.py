"""Small column helpers shared by the expression modules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def try_cast(c, data_type: str) -> Column:
    """Cast that yields null instead of raising under ANSI mode."""
    return col(c).try_cast(data_type)
