"""Splits by the ends of their parts equal those by the rank of every row, without a window over the rows."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from acreage.ml import select, split, train


def ranked_ids(d, key, seed):
    return {r["i"]: (r["__rank"], r["_tot"]) for r in split._ranked(d, key, seed).select("i", "__rank", "_tot").collect()}


@pytest.mark.parametrize("n", [1, 3, 7, 5003])
def test_parts_are_those_of_the_ranks(spark, n):
    d = spark.range(n).select(F.col("id").alias("i"), F.concat(F.lit("k"), "id").alias("key"))
    ranks = ranked_ids(d, "key", 42)
    got = split.holdout(d, "key", 0.2, 42)
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {r["i"] for r in got.where("is_test").collect()} == {i for i, (r, n) in ranks.items() if r <= -(-n // 5)}
    small, rem = divmod(n, 5)
    fold = lambda r: r // (small + 1) if r < rem * (small + 1) else rem + (r - rem * (small + 1)) // small
    folds = split.kfold(d, "key", 5, 42)
    assert dict(folds.dtypes)["fold"] == "int"
    assert {r["i"]: r["fold"] for r in folds.collect()} == {i: fold(r - 1) for i, (r, _) in ranks.items()}


def test_repeated_null_and_no_keys(spark):
    d = spark.createDataFrame([(i, None if i % 3 == 0 else i % 4) for i in range(50)], "i int, key int")
    assert split.holdout(d, "key").where("is_test").count() == 10
    assert sorted(r["n"] for r in split.kfold(d, "key", 7).groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()) == [7] * 6 + [8]
    none = d.where("i < 0")
    assert split.holdout(none, "key").count() == split.kfold(none, "key").count() == 0


def test_permuted_copies_are_ranked_in_one_plan(spark):
    rng = np.random.default_rng(5)
    d = spark.createDataFrame([(f"r{i}", float(a), float(b), int(c), float(3 * a + b + c + 1)) for i, (a, b, c) in enumerate(rng.integers(0, 9, (300, 3)))],
                              "rid string, a double, b double, c int, label double")
    va = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features")
    model = LinearRegression().fit(va.transform(d))
    got = {r["feature"]: r for r in select.permutation_importance(model, d, ["a", "b", "c"], "rid", repeats=4, seed=7, assemble=va.transform).collect()}
    from acreage.operators.ordered import hash_order
    rows = d.toPandas()
    order = lambda s: [r["rid"] for r in d.withColumn("h", hash_order(["rid"], s)).orderBy("h", "rid").collect()]
    own, falls = order(7), {}
    for ci, c in enumerate(["a", "b", "c"]):
        for r in range(4):
            taken = dict(zip(own, rows.set_index("rid")[c].loc[order(7 + 1 + ci * 4 + r)]))
            x = rows.assign(**{c: rows["rid"].map(taken)})
            err = x[["a", "b", "c"]].to_numpy() @ model.coefficients.toArray() + model.intercept - x["label"]
            falls.setdefault(c, []).append(1 - (err ** 2).sum() / (rows["label"].var(ddof=0) * len(rows)))
    base = 1.0
    for c, r2 in falls.items():
        assert abs(got[c]["importance_mean"] - (base - np.mean(r2))) < 1e-6 and abs(got[c]["importance_std"] - np.std(r2, ddof=1)) < 1e-6


def test_forest_keeps_the_nodes_of_rows(spark):
    d = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(
        spark.range(400).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("b"), (F.col("id") % 5).cast("double").alias("label")))
    kept, walked = train.forest(num_trees=5), train.forest(num_trees=5).setCacheNodeIds(False)
    assert kept.getCacheNodeIds()
    assert kept.fit(d).toDebugString.split("\n", 1)[1] == walked.fit(d).toDebugString.split("\n", 1)[1]
