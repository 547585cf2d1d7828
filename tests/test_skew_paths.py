"""Ordered plans give the oracle's answers on real queries whatever the number of
buckets, which follows the session's shuffle partitions."""

import pytest

from acreage.operators import ordered
from acreage.plans.catalog import oracle_sql, queries
from acreage.plans.check import digest, duck

SF = "/root/testdata/sf0.01"
NAMES = ["price_dispersion", "group_box_stats", "ecdf", "qcut_bins", "holdout_split", "kfold", "strat_split",
         "median_fill", "amenity_premium", "describe_stats", "iqr_outliers"]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_many_buckets_match_oracle(spark, con, monkeypatch, name):
    monkeypatch.setattr(ordered, "bucket_number", lambda df: 64)
    got = queries()[name](spark, SF).toPandas()
    exp = con.execute(oracle_sql()[name]).df()
    assert digest(got) == digest(exp)
