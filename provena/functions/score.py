"""Scoring expressions: min-max norms, weights, preferred-flag coercion."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def minmax(x, lo, hi, higher_is_better: bool = True) -> Column:
    """(x-lo)/(hi-lo) or (hi-x)/(hi-lo); a zero range gives 0 (never divides by 0)."""
    x, lo, hi = (_c(v).cast("double") for v in (x, lo, hi))
    rng = hi - lo
    num = (x - lo) if higher_is_better else (hi - x)
    return F.when(rng == 0, F.lit(0.0)).otherwise(num / F.when(rng == 0, F.lit(1.0)).otherwise(rng))


def preferred_flag(c, data_type) -> Column:
    """Boolean / non-zero number / yes,y,true,t,1 → 1, everything else 0."""
    c = _c(c)
    if isinstance(data_type, T.BooleanType):
        v = F.when(c, F.lit(1)).otherwise(F.lit(0))
    elif isinstance(data_type, T.NumericType):
        v = F.when(c.isNotNull() & ~F.isnan(c.cast("double")) & (c != 0), F.lit(1)).otherwise(F.lit(0))
    else:
        v = F.when(F.lower(F.trim(c.cast("string"))).isin("yes", "y", "true", "t", "1"), F.lit(1)).otherwise(F.lit(0))
    return F.coalesce(v, F.lit(0))


@dataclass(frozen=True)
class Weights:
    """Scoring weights: distance (alpha), outbound (beta), inbound (gamma), preferred (delta)."""

    distance: float = 0.5
    referral: float = 0.5
    inbound: float = 0.0
    preferred: float = 0.0

    def normalized(self) -> "Weights":
        total = self.distance + self.referral + self.inbound + self.preferred
        if total <= 0:
            return self
        return Weights(self.distance / total, self.referral / total, self.inbound / total, self.preferred / total)


# FIXED VALUES: published weight scenarios (distance, outbound, inbound, preferred).
SCENARIOS = {
    "Proximity Priority": Weights(0.7, 0.2, 0.1, 0.0),
    "Balanced": Weights(0.4, 0.4, 0.2, 0.0),
    "Workload Distribution": Weights(0.2, 0.1, 0.7, 0.0),
    "Preferred Providers": Weights(0.3, 0.2, 0.0, 0.5),
}
