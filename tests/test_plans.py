"""Plan guards: no registered query plans a cartesian product or a
nested-loop join, and filters / projections reach the Parquet scans."""

import pytest

from acreage.plans.catalog import queries

SF = "/root/testdata/sf0.001"
SKIP = {"stacking", "random_search", "permutation", "forest_fit", "gbt_fit", "rfe", "cluster_diagnostics",
        "furnish_clusters", "ridge_fit", "learners", "boosting_rounds", "feature_ranking"}     # tables of fitted numbers: nothing to plan


@pytest.mark.parametrize("name", sorted(set(queries()) - SKIP))
def test_no_cross_join(spark, name):
    plan = queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_pushdown_and_pruning(spark):
    plan = queries()["pending_links"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_linestatus,F)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_linestatus:string>" in plan
    plan = queries()["price_dispersion"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<p_partkey:bigint>" in plan      # only the join key is read from part
