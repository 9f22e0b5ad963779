"""Declarative factors: a fifth one without touching the planner, null policies, shares of weights."""

import pytest
from pyspark.sql import functions as F

from provena.functions.score import SCENARIOS, Weights
from provena.operators import recommend as rec
from provena.operators.factors import DROP, SKIP, WORST, Factor, reference_factors


def _cands(spark):
    return spark.createDataFrame(
        [("A", 10, 1, 5.0, True, 30.0), ("B", 10, None, 5.0, False, 10.0), ("C", 2, 5, 1.0, False, None), ("D", 6, 3, 9.0, None, 20.0)],
        "full_name string, referral_count long, inbound_referral_count long, distance_miles double, preferred boolean, wait_days double")


@pytest.mark.parametrize("policy,want", [(DROP, {"A": 0.0, "B": 0.5, "D": 0.25}), (SKIP, {"A": 0.0, "B": 0.5, "C": 0.0, "D": 0.25}),
                                         (WORST, {"A": 0.0, "B": 0.5, "C": 0.0, "D": 0.25})])
def test_a_fifth_factor(spark, policy, want):
    w = Weights(0.2, 0.2, 0.1, 0.0)
    waits = Factor("wait", "wait_days", 0.5, higher_is_better=False, null_policy=policy)
    rows = {r["full_name"]: r for r in rec.score_candidates(_cands(spark), w, factors=[*reference_factors(w), waits]).collect()}
    assert set(rows) == set(want)
    for name, r in rows.items():
        base = 0.2 * r["norm_dist"] + 0.2 * r["norm_rank"] + 0.1 * (r["norm_inbound"] or 0.0)
        assert r["score"] == pytest.approx(base + want[name])
        assert (r["norm_wait"] is None) == (name == "C" and policy == SKIP)


def test_converted_and_replaced_factors(spark):
    f = [Factor("slow", "wait_days", 1.0, convert=lambda c, t: F.when(c > 15, 1).otherwise(0)),
         Factor("inb", "inbound_referral_count", 1.0, instead_of=("slow",))]
    rows = {r["full_name"]: r["score"] for r in rec.score_candidates(_cands(spark), Weights(), factors=f).collect()}
    assert rows == {"A": 0.0, "B": 0.0, "C": 1.0, "D": 0.5}
    no_in = _cands(spark).drop("inbound_referral_count")
    assert {r["full_name"]: r["score"] for r in rec.score_candidates(no_in, Weights(), factors=f).collect()} == {"A": 1.0, "B": 0.0, "C": 0.0, "D": 1.0}


def test_scenarios_in_one_pass_equal_one_by_one(spark):
    prov = (_cands(spark).withColumn("latitude", F.lit(38.9) + F.col("distance_miles") / 69).withColumn("longitude", F.lit(-77.0)).drop("distance_miles"))
    got = {}
    for r in rec.compare_scenarios(prov, 38.9, -77.0, SCENARIOS, k=3).collect():
        got.setdefault(r["scenario"], []).append((r["rank"], r["full_name"], round(r["score"], 9)))
    for name, w in SCENARIOS.items():
        one = rec.recommend(prov, 38.9, -77.0, weights=w, k=3).collect()
        assert sorted(got[name]) == sorted((r["rank"], r["full_name"], round(r["score"], 9)) for r in one)


def test_weights_count_by_their_share(spark):
    prov = _cands(spark).withColumn("latitude", F.lit(38.9) + F.col("distance_miles") / 69).withColumn("longitude", F.lit(-77.0)).drop("distance_miles")
    rows = rec.compare_scenarios(prov, 38.9, -77.0, {"a": Weights(0.6, 0.3, 0.1), "b": Weights(6, 3, 1)}, k=None).collect()
    per = {s: sorted((r["rank"], r["full_name"], round(r["score"], 9)) for r in rows if r["scenario"] == s) for s in "ab"}
    assert per["a"] == per["b"] and Weights(0, 0).normalized() == Weights(0, 0)
