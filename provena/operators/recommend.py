"""Scoring and ranking.

Min/max normalisation must run over the *filtered candidate set of each
client*, so it cannot be precomputed per provider:

* one client — the candidate statistics are one scalar subquery (a single
  one-row aggregate with partial aggregation; no window over all rows, no
  cross join);
* many clients — ``groupBy(client_id)`` statistics (partially aggregated,
  so a hot client is pre-combined map-side) equi-joined back on
  ``client_id``; top-k per client uses ``row_number() <= k``, which Spark
  plans with a ``WindowGroupLimit`` that trims every map partition to k
  rows per client before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provena.functions import geo
from provena.functions.score import Weights
from provena.operators.factors import Factor, ScorePlan, reference_factors

#: The weight that each of the application's factors takes.
WEIGHT_OF = {"dist": "distance", "rank": "referral", "inbound": "inbound", "pref": "preferred"}


def filter_specialty(df: DataFrame, specialties: list[str] | None) -> DataFrame:
    """Keep a provider if ANY trimmed comma part of its specialty is selected."""
    if not specialties or "specialty" not in df.columns:
        return df
    parts = F.transform(F.split(F.col("specialty"), ","), lambda s: F.trim(s))
    return df.filter(F.coalesce(F.arrays_overlap(parts, F.array(*[F.lit(s) for s in specialties])), F.lit(False)))


def filter_min_referrals(df: DataFrame, n) -> DataFrame:
    """B15."""
    return df if n is None else df.filter(F.col("referral_count") >= F.lit(n))


def filter_radius(df: DataFrame, radius_miles) -> DataFrame:
    """Distance ≤ radius (null distances drop out)."""
    if radius_miles is None or "distance_miles" not in df.columns:
        return df
    return df.filter(F.col("distance_miles") <= F.lit(float(radius_miles)))


def with_distance(df: DataFrame, lat: float, lon: float) -> DataFrame:
    """H16 for one client location."""
    return df.withColumn("distance_miles", geo.haversine_miles(F.lit(float(lat)), F.lit(float(lon)),
                                                               F.col("latitude"), F.col("longitude")))


def sort_keys(w: Weights, has_inbound: bool, tie_break: str = "reference") -> list[Column]:
    """F1: score desc; then distance & count (order chosen by the weights), inbound, name.

    ``reference`` breaks distance ties *farther first* (the application's
    rule, Q8); ``nearest`` puts nearer first.
    """
    dist = (F.col("distance_miles").desc_nulls_last() if tie_break == "reference"
            else F.col("distance_miles").asc_nulls_last())
    cnt = F.col("referral_count").desc_nulls_last()
    keys = [F.col("score").desc_nulls_last()]
    keys += [dist, cnt] if w.distance > w.referral else [cnt, dist]
    if has_inbound:
        keys.append(F.col("inbound_referral_count").desc_nulls_last())
    keys.append(F.col("full_name").asc_nulls_last())
    return keys


def score_candidates(cands: DataFrame, w: Weights, by: list[str] | None = None,
                     min_referrals=None, score_mode: str = "reference", factors: list[Factor] | None = None) -> DataFrame:
    """D6 + H17 + H18 over the candidate set (per ``by`` group, or all rows).

    Candidates need non-null distance and count.  ``score_mode="reference"``
    reproduces the application: with an inbound weight the score of rows
    that have an inbound count is *recomputed* without the preferred term
    (Q7); ``"additive"`` adds all four terms as documented.  ``factors``
    replaces the application's factors by others.
    """
    plan = ScorePlan(factors or reference_factors(w, score_mode), cands)
    df = plan.flagged(filter_min_referrals(cands, min_referrals))
    scored = plan.scored(df, plan.statistics(df, by or []), by)
    return shown(scored, plan)


def shown(scored: DataFrame, plan: ScorePlan) -> DataFrame:
    """The result's columns: converted values and the preferred norm are left out, the inbound norm is always there."""
    if "norm_inbound" not in scored.columns:
        scored = scored.withColumn("norm_inbound", F.lit(None).cast("double"))
    return scored.drop(*plan.flags, "norm_pref")


def rank_scored(scored: DataFrame, w: Weights, by: list[str] | None = None, k: int | None = None,
                dedup_names: bool = True, tie_break: str = "reference", keys: list[Column] | None = None) -> DataFrame:
    """E5 + E6 + F3: best row per name, then dense ranks 1..n per ``by`` group (≤ k)."""
    keys = keys or sort_keys(w, "inbound_referral_count" in scored.columns, tie_break)
    by = by or []
    df = scored
    if dedup_names:
        wn = Window.partitionBy(*by, "full_name").orderBy(*keys)
        df = df.withColumn("_rn", F.row_number().over(wn)).filter(F.col("_rn") == 1).drop("_rn")
    wr = Window.partitionBy(*by).orderBy(*keys)
    df = df.withColumn("rank", F.row_number().over(wr))
    if k is not None:
        df = df.filter(F.col("rank") <= F.lit(int(k)))
    return df


def recommend(providers: DataFrame, lat: float, lon: float, *, min_referrals=0, max_radius_miles=None,
              weights: Weights = Weights(), specialties: list[str] | None = None, k: int | None = None,
              score_mode: str = "reference", tie_break: str = "reference") -> DataFrame:
    """I6 for one client: filters → distance → radius → score → rank (top-k when ``k``).

    With ``k`` the ranking is a per-partition top-k before one small
    exchange.  Without ``k`` the full ranked list is returned; ranks come
    from a distributed sort (see ``global_rank``).
    """
    df = filter_specialty(providers, specialties)
    df = filter_min_referrals(df, min_referrals)
    df = with_distance(df, lat, lon)
    df = filter_radius(df, max_radius_miles)
    scored = score_candidates(df, weights, None, min_referrals, score_mode)
    if k is not None:
        return rank_scored(scored, weights, None, k, True, tie_break)
    return global_rank(scored, weights, tie_break)


def global_rank(scored: DataFrame, w: Weights, tie_break: str = "reference") -> DataFrame:
    """E5 + E6 for one client without funnelling all rows through one task.

    Best row per name (window partitioned by name), then a range-partitioned
    global sort; each row's rank is its position inside its sorted partition
    plus the row counts of the partitions before it (a table with one row
    per partition, so broadcasting it is bounded by the partition count).
    The sorted data is checkpointed to the shared folder so both uses see
    the same partitions, also after an executor loss.
    """
    from provena.session import cut_lineage
    has_in = "inbound_referral_count" in scored.columns
    keys = sort_keys(w, has_in, tie_break)
    wn = Window.partitionBy("full_name").orderBy(*keys)
    best = scored.withColumn("_rn", F.row_number().over(wn)).filter(F.col("_rn") == 1).drop("_rn")
    ordered = best.orderBy(*keys).withColumn("_mid", F.monotonically_increasing_id())
    ordered = cut_lineage(ordered)
    part = F.shiftright(F.col("_mid"), 33)
    counts = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn(
        "_off", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = (ordered.join(F.broadcast(offsets.select("_part", "_off")), part == F.col("_part"))
              .withColumn("rank", (F.col("_off") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("int")))
    return ranked.drop("_mid", "_part", "_off")


def best_provider(scored: DataFrame, w: Weights, tie_break: str = "reference") -> DataFrame:
    """the single best row (``TakeOrderedAndProject``)."""
    return scored.orderBy(*sort_keys(w, "inbound_referral_count" in scored.columns, tie_break)).limit(1)


def compare_scenarios(providers: DataFrame, lat: float, lon: float, scenarios: dict[str, Weights],
                      *, min_referrals=0, max_radius_miles=None, k: int | None = 10, score_mode: str = "reference") -> DataFrame:
    """Top-k under every weight scenario, in one pass (H19: weights count by their share of the scenario's sum).

    Norms don't depend on weights, so they are computed once; every candidate then becomes a row per scenario, which the
    top-k trims in each partition before the exchange.
    """
    df = filter_min_referrals(providers, min_referrals)
    df = filter_radius(with_distance(df, lat, lon), max_radius_miles)
    shares = {name: w.normalized() for name, w in scenarios.items()}
    # Every factor that some scenario weighs takes part; its own weight only says so.
    most = Weights(*[max(getattr(w, c) for w in shares.values()) for c in WEIGHT_OF.values()])
    plan = ScorePlan(reference_factors(most, score_mode), df)
    flagged = plan.flagged(df)
    normed = plan.scored(flagged, plan.statistics(flagged, [])).drop("score")
    per = F.explode(F.array(*[F.struct(F.lit(name).alias("scenario"), *[F.lit(float(getattr(w, c))).alias(f"_w_{f}") for f, c in WEIGHT_OF.items()])
                              for name, w in shares.items()]))
    rows = normed.withColumn("_s", per).select("*", "_s.*").drop("_s")
    rows = rows.withColumn("score", plan.weighted(lambda f: F.col(f"_w_{f.name}")))
    if "norm_inbound" in rows.columns:
        rows = rows.withColumn("norm_inbound", F.when(F.col("_w_inbound") > 0, F.col("norm_inbound")))
    first = F.col("_w_dist") > F.col("_w_rank")
    distance, count = F.col("distance_miles"), F.col("referral_count").cast("double")
    keys = [F.col("score").desc_nulls_last(), F.when(first, distance).otherwise(count).desc_nulls_last(),
            F.when(first, count).otherwise(distance).desc_nulls_last()]
    keys += [F.col("inbound_referral_count").desc_nulls_last()] if "inbound_referral_count" in rows.columns else []
    ranked = rank_scored(rows, Weights(), ["scenario"], k, keys=[*keys, F.col("full_name").asc_nulls_last()])
    return shown(ranked.drop(*[f"_w_{f}" for f in WEIGHT_OF]), plan)
