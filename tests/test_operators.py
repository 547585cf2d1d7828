"""Operator fixtures for the documented traps (hand-written rows)."""

import math
import os
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from acreage.operators import features, impute, rules, similarity, stats, views
from acreage.sources import io


def test_mode_fill_three_passes(spark):
    rows = [
        # sector, type, age
        ("s1", "flat", "Undefined"), ("s1", "flat", "Undefined"), ("s1", "flat", "New"),   # Undefined wins its own mode
        ("s2", "flat", "Undefined"), ("s2", "flat", "Old"), ("s2", "flat", "New"),          # tie Old/New -> New (alpha)
        ("s2", "house", "Undefined"),                                                     # pass 1: mode is Undefined
        (None, "flat", "Undefined"),                                                      # null sector: pass 3 by type
        ("s3", None, "Undefined"),                                                        # null type, sector s3 alone
    ]
    df = spark.createDataFrame(rows, "sector string, property_type string, age string")
    out = impute.mode_fill(df, "age", "Undefined").toPandas()
    got = sorted(out.fillna("NULL").itertuples(index=False, name=None))
    # pass 1 (sector, type): s1/flat mode Undefined (2:1) -> stays; s2/flat tie -> 'New'; s2/house -> Undefined
    # pass 2 (sector): s2 -> New (2) so s2/house -> New; s1 still Undefined
    # pass 3 (type): flat = New 3 / Undefined 3 / Old 1 -> tie -> 'New'; null-type row never matched
    assert got == sorted([("s1", "flat", "New"), ("s1", "flat", "New"), ("s1", "flat", "New"),
                          ("s2", "flat", "New"), ("s2", "flat", "Old"), ("s2", "flat", "New"),
                          ("s2", "house", "New"), ("NULL", "flat", "New"), ("s3", "NULL", "Undefined")])


def test_cap_rare(spark):
    df = spark.createDataFrame([("a",)] * 5 + [("b",)] * 4 + [(None,)], "s string")
    out = sorted((r[0] or "NULL") for r in impute.cap_rare(df, "s", 5).collect())
    assert out == ["NULL"] + ["Other"] * 4 + ["a"] * 5


def test_qcut_trap(spark):
    vals = [1.0] * 6 + [2.0, 3.0, 4.0]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    out = impute.qcut(df, "v", 3, ["Budget", "Semi-Luxury", "Luxury"]).collect()
    # edges collapse (1, 1, 2.333, 4) -> 2 bins, numbered instead of raising
    assert {r["bin"] for r in out} == {"bin_0", "bin_1"}
    assert sum(1 for r in out if r["bin_code"] == 0) == 6


def test_row_median(spark):
    df = spark.createDataFrame([(1.0, None, 3.0), (None, None, None), (4.0, 2.0, 9.0), (1.0, 2.0, None)],
                               "a double, b double, c double")
    assert [r[0] for r in df.select(impute.row_median(["a", "b", "c"])).collect()] == [2.0, None, 4.0, 1.5]


def test_ratio_rule(spark):
    df = spark.createDataFrame([(1000.0, 0), (1000.0, 6), (1750.0, 7), (2100.0, 7), (None, 2)],
                               "a double, b int")
    keep = [r[0] for r in df.select(rules.ratio_rule("a", "b")).collect()]
    assert keep == [True, False, False, True, False]


def test_report_counts(spark):
    df = spark.createDataFrame([(1.0, 10.0), (None, 5.0), (3.0, 500.0), (4.0, None)], "p double, r double")
    rep = rules.report(df, {"req": rules.require(["p"]), "cap": rules.cap("r", 100)}).collect()
    d = {r["rule"]: r for r in rep}
    assert d["req"]["n_removed"] == 1 and d["cap"]["n_failed"] == 2 and d["cap"]["n_removed"] == 2
    assert d["cap"]["n_after"] == 1


def test_geo_trim_trap(spark):
    L = spark.createDataFrame([("farukhnagar", 1.0)], "sector string, rate double")
    coords = spark.createDataFrame([("farukhnagar ", "28.44° N, 76.82° E")], "sector string, coordinates string")
    coords = views.parse_coordinates(coords, "coordinates")
    assert views.geo_join(L, coords, "sector", trim_keys=False).count() == 0
    r = views.geo_join(L, coords, "sector", trim_keys=True).collect()
    assert len(r) == 1 and r[0]["latitude"] == 28.44 and r[0]["longitude"] == 76.82


def test_complement_median_vs_bruteforce(spark, monkeypatch):
    from acreage.operators import ordered
    monkeypatch.setattr(ordered, "bucket_number", lambda df: 64)
    rng = np.random.default_rng(7)
    n = 3000
    am = [list(rng.choice(["gym", "pool", "lift", "park"], size=rng.integers(0, 4), replace=False)) for _ in range(n)]
    rate = np.round(rng.lognormal(8, 0.5, n), 1)
    rate[::50] = np.nan
    pdf = pd.DataFrame({"k": range(n), "rate": rate, "am": am})
    df = spark.createDataFrame(pdf, "k long, rate double, am array<string>")
    w = {r["amenity"]: r for r in features.amenity_weights(df, "k", "am", "rate", 30).collect()}
    for a in ["gym", "pool", "lift", "park"]:
        has = pdf.am.apply(lambda x, a=a: a in x)
        assert math.isclose(w[a]["median_present"], pdf.rate[has].median(), rel_tol=1e-12)
        assert math.isclose(w[a]["median_absent"], pdf.rate[~has].median(), rel_tol=1e-12)


def test_sparse_default_cosine_vs_dense(spark):
    rows = [(1, "a", 100.0), (1, "b", 60000.0), (2, "a", 500.0), (3, "c", 10.0), (3, "a", 20000.0), (2, "c", 70000.0)]
    long = spark.createDataFrame(rows, "k long, landmark_key string, dist_m double")
    present, defaults = similarity.proximity(long, "k")
    q = spark.createDataFrame([(1,)], "k long")
    got = {r["k"]: r["score"] for r in similarity.sparse_default_cosine(present, defaults, "k", q).collect()}
    # dense brute force
    pdf = pd.DataFrame(rows, columns=["k", "l", "d"]).pivot(index="k", columns="l", values="d").fillna(54000.0)
    lo, hi = pdf.min(), pdf.max()
    s = 1 - (pdf - lo) / (hi - lo).replace(0, np.nan)
    s = s.fillna(1.0)
    v = s.to_numpy()
    nv = v / np.linalg.norm(v, axis=1, keepdims=True)
    exp = dict(zip(pdf.index, nv @ nv[list(pdf.index).index(1)]))
    for k in exp:
        assert math.isclose(got[k], exp[k], rel_tol=1e-9, abs_tol=1e-12)


def test_tfidf_matches_sklearn_formula(spark):
    docs = spark.createDataFrame([(1, "Swimming Pool, Gym"), (2, "Gym and Lift"), (3, "the the")],
                                 "k long, t string")
    w = {(r["k"], r["term"]): r["weight"] for r in similarity.tfidf(docs, "k", "t", 2, ["and", "the"]).collect()}
    # doc 1 terms: swimming, pool, gym, "swimming pool", "pool gym"; df: gym=2, others 1; n=3
    idf1, idf2 = math.log(4 / 2) + 1, math.log(4 / 3) + 1
    v = np.array([idf1, idf1, idf2, idf1, idf1])
    assert math.isclose(w[(1, "gym")], idf2 / np.linalg.norm(v), rel_tol=1e-12)
    assert (3, "the") not in w


def test_csv_reader_quotes(spark):
    d = tempfile.mkdtemp(prefix="acreage-csv-")
    p = os.path.join(d, "coef.csv")
    with open(p, "w") as fh:
        fh.write('feature,coef\n"society_sector 9a, gurgaon",0.5\nsector_sector 42,0.61\n')
    df = io.read_csv(spark, p, io.COEFFICIENT)
    assert sorted(tuple(r) for r in df.collect()) == [("sector_sector 42", 0.61), ("society_sector 9a, gurgaon", 0.5)]
    with pytest.raises(FileNotFoundError):
        io.read_csv(spark, os.path.join(d, "missing.csv"), io.COEFFICIENT)


def test_upsert_keeps_batch(spark):
    a = spark.createDataFrame([("l1", 1, "old"), ("l2", 1, "x")], "link string, o int, v string")
    b = spark.createDataFrame([("l1", 0, "new")], "link string, o int, v string")
    out = {r["link"]: r["v"] for r in io.upsert_latest(a, b, "link", ["o"]).collect()}
    assert out == {"l1": "new", "l2": "x"}


def test_describe_and_shape(spark):
    vals = [1.0, 2.0, 2.0, 3.0, 10.0, None]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    d = stats.describe(df, "v").first()
    s = pd.Series(vals, dtype=float)
    assert d["count"] == 5 and math.isclose(d["std"], s.std()) and d["q50"] == s.median()
    sh = stats.shape(df, "v").first()
    assert math.isclose(sh["skew"], s.skew(), rel_tol=1e-9) and math.isclose(sh["kurt"], s.kurt(), rel_tol=1e-9)


def test_ecdf_ends_at_one_without_nulls(spark):
    df = spark.createDataFrame([(float(x % 7),) for x in range(100)], "v double")
    e = stats.ecdf(df, "v").orderBy("value").collect()
    assert math.isclose(e[-1]["ecdf"], 1.0)


def test_feature_score_formula(spark):
    # fixed values: three rows of a published importance table (rf, gb, perm, rfe rank)
    rows = [("a", 0.5, 0.4, 0.2, 1), ("b", 0.1, 0.2, 0.05, 2), ("c", 0.3, 0.1, 0.1, 3)]
    df = spark.createDataFrame(rows, "feature string, rf double, gb double, perm double, rfe_rank int")
    from acreage.ml.select import feature_score
    out = {r["feature"]: r for r in feature_score(df).collect()}
    assert math.isclose(out["a"]["avg_importance"], 1.0) and math.isclose(out["a"]["final_score"], 1.0)
    assert math.isclose(out["b"]["avg_importance"], (0 + 1 / 3 + 0) / 3)


def test_sample_does_not_depend_on_partitions(spark):
    from acreage.sources import io
    df = spark.range(1001).selectExpr("id", "id % 7 as v")
    picks = [sorted(r["id"] for r in io.sample(df.repartition(p), 0.1, 7, "id").collect()) for p in (1, 64)]
    assert picks[0] == picks[1] and len(picks[0]) == 101
    assert io.sample(df, 0.1, 8, "id").where(~df.id.isin(picks[0])).count() > 50
    assert io.sample(df, 0.0, 7).count() == 0 and io.sample(df, 1.0, 7).count() == 1001
    assert io.sample(df.limit(0), 0.5).count() == 0


def test_cost_of_one_cluster(spark):
    from pyspark.ml.functions import array_to_vector
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 3))
    df = spark.createDataFrame([(r.tolist(),) for r in x], "a array<double>").select(array_to_vector("a").alias("f"))
    rows = {r["k"]: r for r in features.cluster_diagnostics(df, "f", [1, 2], inits=2).collect()}
    assert math.isclose(rows[1]["inertia"], ((x - x.mean(0)) ** 2).sum(), rel_tol=1e-9) and rows[1]["silhouette"] is None
    assert rows[2]["inertia"] < rows[1]["inertia"] and rows[2]["silhouette"] is not None
