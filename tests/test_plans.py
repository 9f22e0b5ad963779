"""Plan-shape guarantees over every registered query of the referral library."""

import pytest

from provena.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
FORBIDDEN = ["BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_or_pair_explosion(spark, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    bad = [f for f in FORBIDDEN if f in plan]
    assert not bad, f"{name}: {bad}"
