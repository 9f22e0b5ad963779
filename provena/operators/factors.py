"""Declarative scoring factors (K): what a score is made of, and one planner for statistics, norms, score and bounds.

A factor names a column, its direction, its weight and what a missing value means.  ``ScorePlan`` turns a list of
them into native columns: the extremes every norm needs (one aggregate), the min-max norms, the weighted sum, and
an upper bound of the sum for a group of candidates known by its extremes alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provena.functions import score
from provena.functions.score import Weights

#: A candidate without a value isn't scored / scores without this factor / counts as the worst value.
DROP, SKIP, WORST = "drop", "skip", "worst"
DISTANCE = "distance_miles"


@dataclass(frozen=True)
class Factor:
    """One term of a score: ``weight`` x the column's min-max norm over the candidates.

    ``convert`` makes a number of a column that isn't one (given its type).  ``instead_of`` names factors whose terms
    are left out for candidates that have a value here.  ``always``: the factor is part of the plan (its null
    policy, its norm) whatever its weight; others take no part at weight 0 or where the column is absent.
    """

    name: str
    column: str
    weight: float
    higher_is_better: bool = True
    null_policy: str = SKIP
    convert: Callable[[Column, T.DataType], Column] | None = None
    instead_of: tuple[str, ...] = ()
    always: bool = False


def reference_factors(w: Weights, score_mode: str = "reference") -> list[Factor]:
    """The application's score.  ``reference``: with an inbound weight, candidates that have an inbound count are scored
    without the preferred term (Q7); ``additive`` adds all four terms as documented."""
    return [
        Factor("dist", DISTANCE, w.distance, higher_is_better=False, null_policy=DROP, always=True),
        Factor("rank", "referral_count", w.referral, null_policy=DROP, always=True),
        Factor("pref", "preferred", w.preferred, null_policy=WORST, convert=score.preferred_flag),
        Factor("inbound", "inbound_referral_count", w.inbound, instead_of=("pref",) if score_mode == "reference" else ()),
    ]


class ScorePlan:
    """Scores candidates (rows with the factors' columns) by ``factors``; ``like`` gives the columns' types."""

    def __init__(self, factors: list[Factor], like: DataFrame):
        types = {f.name: f.dataType for f in like.schema.fields}
        self.factors = [f for f in factors if f.always or (f.weight > 0 and f.column in types)]
        self.types = types
        self.flags = [self.value(f) for f in self.factors if f.convert]

    @staticmethod
    def value(f: Factor) -> str:
        return f"_value_{f.name}" if f.convert else f.column

    def flagged(self, df: DataFrame) -> DataFrame:
        """With converted columns, without candidates that miss a required value."""
        for f in self.factors:
            if f.convert and self.value(f) not in df.columns:
                df = df.withColumn(self.value(f), f.convert(F.col(f.column), self.types[f.column]))
        present = set(df.columns)
        for f in self.factors:
            if f.null_policy == DROP and self.value(f) in present:
                df = df.filter(F.col(self.value(f)).isNotNull())
        return df

    def statistics(self, flagged: DataFrame, by: list[str]) -> DataFrame:
        """Extremes of every factor, per ``by`` group or over all rows."""
        return flagged.groupBy(*by).agg(*[g(self.value(f)).alias(f"_{n}_{f.name}") for f in self.factors for n, g in (("min", F.min), ("max", F.max))])

    @property
    def statistic_columns(self) -> list[str]:
        return [f"_{n}_{f.name}" for f in self.factors for n in ("min", "max")]

    def scored(self, flagged: DataFrame, stats: DataFrame | None, by: list[str] | None = None) -> DataFrame:
        """With a norm per factor (``norm_<name>``) and ``score``.  Without ``by`` the statistics are one row (a scalar subquery);
        without ``stats`` every row has them already."""
        extremes = self.statistic_columns
        if stats is None:
            df = flagged
        elif by:
            df = flagged.join(stats, by, "inner")
        else:
            one = stats.select(F.struct(*stats.columns).alias("s")).scalar()
            df = flagged.withColumns({c: one.getField(c) for c in extremes})
        norms = {}
        for f in self.factors:
            norm = score.minmax(self.value(f), f"_min_{f.name}", f"_max_{f.name}", f.higher_is_better)
            if f.null_policy == SKIP:
                norm = F.when(F.col(self.value(f)).isNotNull(), norm)
            elif f.null_policy == WORST:
                norm = F.coalesce(norm, F.lit(0.0))
            norms[f"norm_{f.name}"] = norm
        return df.withColumns(norms).withColumn("score", self.weighted()).drop(*extremes)

    def weighted(self, weight: Callable[[Factor], Column] | None = None) -> Column:
        """The sum over the norm columns; ``weight`` gives a factor's weight if it isn't the factor's own."""
        weight = weight or (lambda f: F.lit(float(f.weight)))
        total = None
        for f in self.factors:
            term = F.coalesce(weight(f) * F.col(f"norm_{f.name}"), F.lit(0.0))
            for other in self.factors:
                if f.name in other.instead_of:
                    term = F.when(F.col(self.value(other)).isNotNull() & (weight(other) > 0), F.lit(0.0)).otherwise(term)
            total = term if total is None else total + term
        return total

    # --- groups of candidates known by their extremes ------------------------
    def _grouped(self) -> list[Factor]:
        return [f for f in self.factors if f.column != DISTANCE]

    def extremes(self) -> list[Column]:
        """Summary columns of a group of candidates (all factors but the distance, which depends on the client)."""
        return [g(self.value(f)).alias(f"_{n}_{f.name}") for f in self._grouped() for n, g in (("low", F.min), ("high", F.max))]

    def combined(self, stats: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
        """``stats`` of single candidates widened by whole groups (whose distances ``stats`` is known to span)."""
        own = [f"_{n}_{f.name}" for f in self.factors for n in ("min", "max")]
        whole = [(F.col(f"_{'low' if n == 'min' else 'high'}_{f.name}") if f in self._grouped() else F.lit(None).cast("double")).alias(f"_{n}_{f.name}")
                 for f in self.factors for n in ("min", "max")]
        both = stats.select(*by, *own).unionByName(groups.select(*by, *whole))
        return both.groupBy(*by).agg(*[(F.min if c.startswith("_min_") else F.max)(c).alias(c) for c in own])

    def best_possible(self, nearest: str) -> Column:
        """No candidate of a group scores higher than this (given the statistics' columns and the group's extremes)."""
        total = F.lit(0.0)
        for f in self.factors:
            if f.column == DISTANCE:
                best = nearest if not f.higher_is_better else f"_max_{f.name}"
            else:
                best = f"_high_{f.name}" if f.higher_is_better else f"_low_{f.name}"
            norm = score.minmax(best, f"_min_{f.name}", f"_max_{f.name}", f.higher_is_better)
            total = total + F.greatest(F.lit(0.0), F.lit(float(f.weight)) * F.least(F.lit(1.0), F.coalesce(norm, F.lit(0.0))))
        return total
