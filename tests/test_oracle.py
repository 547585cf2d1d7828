"""Every registered query with an oracle matches DuckDB on the same tables
(row count, column names, order-insensitive value hash) — the same check the
driver runs, here at sf0.001 to keep the suite quick.  Queries without an
oracle must run and return rows."""

import pytest

from acreage.plans.catalog import oracle_sql, queries
from acreage.plans.check import digest, duck, type_diffs

SF = "/root/testdata/sf0.001"
ORACLE = oracle_sql()
ROWS_ONLY_SLOW = {"stacking", "random_search", "permutation", "forest_fit", "gbt_fit", "rfe", "fuzzy_name_clusters",
                  "cluster_diagnostics", "furnish_clusters", "ridge_fit", "ridge_impact", "ridge_premium", "model_store",
                  "learners", "feature_ranking", "name_linkage"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    sdf = queries()[name](spark, SF)
    got = sdf.toPandas()
    exp = con.execute(ORACLE[name]).df()
    assert digest(got) == digest(exp)
    assert type_diffs(sdf, con, ORACLE[name]) == []


@pytest.mark.parametrize("name", sorted(set(queries()) - set(ORACLE)))
def test_rows_only_query_runs(spark, name):
    if name in ROWS_ONLY_SLOW:
        pytest.skip("model fit: its learner has tests of its own, the driver runs the query")
    assert queries()[name](spark, SF).count() > 0
