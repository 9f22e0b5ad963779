"""Report figures from sketches kept per load (D17, D24): what a load adds is summed up once, reports merge the sums.

Distinct names come from HyperLogLog sketches (``hll_sketch_agg``), whose relative standard error is about
``1.04 / sqrt(2 ** lg_k)`` (0.8% at the default of 14 bits, so ``ERROR_BOUND``, three of them, is rarely missed).
How the rows are cut into loads changes an estimate a little, within the bound.  Reports cost some kilobytes per
load and type, where an exact distinct count shuffles every name.  The exact reports stay the default.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K = 14
ERROR_BOUND = 3 * 1.04 / math.sqrt(2**LG_K)
#: Relative accuracy of approximate percentiles is 1 / this.
ACCURACY = 10_000


def load_sketches(referrals: DataFrame, load: Column, by: tuple[str, ...] = ("referral_type",), lg_k: int = LG_K) -> DataFrame:
    """One row per load and group: rows, the span of dates, and a sketch of the provider names."""
    return referrals.groupBy(load.alias("load"), *by).agg(
        F.count(F.lit(1)).alias("referrals"), F.min("date_of_intake").alias("first_intake"), F.max("date_of_intake").alias("last_intake"),
        F.hll_sketch_agg("full_name", F.lit(lg_k)).alias("names"))


def merged(sketches: DataFrame, by: tuple[str, ...] = ("referral_type",)) -> DataFrame:
    """The report over all loads (or those the caller kept): rows exact, names within ``ERROR_BOUND``."""
    return sketches.groupBy(*by).agg(
        F.sum("referrals").alias("referrals"), F.min("first_intake").alias("first_intake"), F.max("last_intake").alias("last_intake"),
        F.count(F.lit(1)).alias("loads"), F.hll_sketch_estimate(F.hll_union_agg("names")).alias("providers"))


def approximate_statistics(referrals: DataFrame, accuracy: int = ACCURACY) -> DataFrame:
    """D24 without collecting a group's counts: the median of referrals per provider by ``approx_percentile``, whose rank is
    off by at most ``1 / accuracy`` of the providers; everything else exact."""
    per = referrals.filter(F.col("full_name").isNotNull()).groupBy("referral_type", "full_name").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("referral_type").agg(
        F.sum("n").alias("referrals"), F.count(F.lit(1)).alias("providers"), F.max("n").alias("max_per_provider"),
        F.approx_percentile("n", F.lit(0.5), F.lit(accuracy)).alias("median_per_provider"))
