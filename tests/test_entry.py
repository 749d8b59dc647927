"""The driver contract."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_every_twin_belongs_to_a_query():
    queries, twins = entry.queries(), entry.oracle_sql()
    assert set(twins) <= set(queries) and len(queries) > 100
    assert all(callable(q) for q in queries.values()) and all(isinstance(s, str) for s in twins.values())


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
def test_flagship_runs_on_the_smallest_scale(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert rows and {"strategy", "split", "sharpe_ratio", "display_name"} <= set(df.columns)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
@pytest.mark.parametrize("name", ["transition_matrix", "news_weekly", "hmm_filter_native", "histogram"])
def test_plans_hold_no_cross_join_or_row_udf(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(s in plan for s in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"))
