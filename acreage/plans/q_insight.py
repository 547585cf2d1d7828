"""Registered queries: pricing insight (2.L) bound to the listing view.

Coefficients come from the data: per-level effects on log1p(price) for sector
and society, and the correlation of each numeric feature with log1p(price);
standard deviations and the median base price are aggregates of the same
view.  The scenario grid is the what-if input (the dashboard's widget values).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from acreage.operators import insight
from acreage.plans.bindings import L_SQL, listing_view, round_doubles
from acreage.plans.registry import query

NUMERIC = {"total_area_sqft": "area", "bedrooms": "bedrooms", "servant_room": "servant_room",
           "pooja_room": "pooja_room"}


def _model_view(spark, sf):
    L = listing_view(spark, sf)
    return L.select("sector", "society", (F.col("price") / 100000).alias("price_in_cr"),
                    F.log1p(F.col("price") / 100000).alias("y"), (F.col("area") * 100).alias("total_area_sqft"),
                    "bedrooms", (F.col("returnflag") == "R").cast("int").alias("servant_room"),
                    (F.col("linestatus") == "O").cast("int").alias("pooja_room"))


def _coefs(m):
    g = insight.group_effects(m, "y", {"sector": "sector_", "society": "society_"})
    num = m.agg(*[F.corr(c, "y").alias(c) for c in NUMERIC])
    num = num.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("coef")) for c in NUMERIC])))
    return g.unionByName(num)


M_SQL = "WITH " + L_SQL + """
, M AS (SELECT sector, society, price / 100000 AS price_in_cr, ln(1 + price / 100000) AS y, area * 100 AS total_area_sqft,
               bedrooms, CAST(returnflag = 'R' AS INTEGER) AS servant_room, CAST(linestatus = 'O' AS INTEGER) AS pooja_room
        FROM L)
, C AS (SELECT 'sector_' || sector AS feature, avg(y) - (SELECT avg(y) FROM M) AS coef FROM M GROUP BY sector
        UNION ALL SELECT 'society_' || society, avg(y) - (SELECT avg(y) FROM M) FROM M GROUP BY society
        UNION ALL SELECT 'total_area_sqft', corr(total_area_sqft, y) FROM M
        UNION ALL SELECT 'bedrooms', corr(bedrooms, y) FROM M
        UNION ALL SELECT 'servant_room', corr(servant_room, y) FROM M
        UNION ALL SELECT 'pooja_room', corr(pooja_room, y) FROM M)
, S AS (SELECT 'total_area_sqft' AS feature, stddev_samp(total_area_sqft) AS std FROM M
        UNION ALL SELECT 'bedrooms', stddev_samp(bedrooms) FROM M
        UNION ALL SELECT 'servant_room', stddev_samp(servant_room) FROM M
        UNION ALL SELECT 'pooja_room', stddev_samp(pooja_room) FROM M)
, B AS (SELECT quantile_cont(price_in_cr, 0.5) * 1e7 AS base_price_rs FROM M)
, SC AS (SELECT * FROM (VALUES
   ('area+100', 'total_area_sqft', 100.0), ('area+500', 'total_area_sqft', 500.0), ('area+1000', 'total_area_sqft', 1000.0),
   ('bed+1', 'bedrooms', 1.0), ('bed-1', 'bedrooms', -1.0), ('servant', 'servant_room', 1.0), ('pooja', 'pooja_room', 1.0),
   ('upgrade', 'total_area_sqft', 300.0), ('upgrade', 'bedrooms', 1.0), ('upgrade', 'servant_room', 1.0))
   t(scenario, feature, delta))
, I AS (SELECT scenario, feature, delta, coef * (delta / std) AS lc, base_price_rs
        FROM SC JOIN C USING (feature) JOIN S USING (feature), B)"""

SCENARIOS = [("area+100", "total_area_sqft", 100.0), ("area+500", "total_area_sqft", 500.0),
             ("area+1000", "total_area_sqft", 1000.0), ("bed+1", "bedrooms", 1.0), ("bed-1", "bedrooms", -1.0),
             ("servant", "servant_room", 1.0), ("pooja", "pooja_room", 1.0),
             ("upgrade", "total_area_sqft", 300.0), ("upgrade", "bedrooms", 1.0), ("upgrade", "servant_room", 1.0)]


def _impacts(spark, sf):
    m = _model_view(spark, sf)
    scen = spark.createDataFrame(SCENARIOS, "scenario string, feature string, delta double")
    base = insight.base_price(m, "price_in_cr")
    return insight.impact(scen, _coefs(m), insight.feature_stds(m, list(NUMERIC)), base), base


@query("price_impact", ops="L1 L2 E26 E27", sql=M_SQL + """
SELECT scenario, feature, CAST(delta AS DOUBLE) AS delta, round(lc, 6) AS log_change, round((exp(lc) - 1) * 100, 6) AS pct_change,
       round(base_price_rs * (exp(lc) - 1), 4) AS abs_change, round(base_price_rs * (exp(lc) - 1) / 1e5, 6) AS lakh_change
FROM I
""")
def price_impact(spark, sf):
    imp, _ = _impacts(spark, sf)
    return round_doubles(imp.withColumn("abs_change", F.round("abs_change", 4)))


@query("scenario", ops="L3", sql=M_SQL + """
SELECT scenario, round(sum(lc), 6) AS log_change, round((exp(sum(lc)) - 1) * 100, 6) AS pct_change,
       round(max(base_price_rs) * (exp(sum(lc)) - 1), 4) AS abs_change
FROM I GROUP BY scenario
""")
def scenario(spark, sf):
    imp, base = _impacts(spark, sf)
    c = insight.combine(imp, base)
    return round_doubles(c.withColumn("abs_change", F.round("abs_change", 4)))


@query("group_premium", ops="L4 L6", sql=M_SQL + """
, P AS (SELECT substring(feature, 8) AS label, coef FROM C WHERE starts_with(feature, 'sector_'))
SELECT label, round(coef, 6) AS coef, round(coef - avg(coef) OVER (), 6) AS coef_vs_avg,
       round((exp(coef - avg(coef) OVER ()) - 1) * 100, 6) AS premium_pct,
       round(abs(exp(coef) - 1) * 100, 6) AS effect_pct,
       CASE WHEN exp(coef) - 1 >= 0 THEN 'increase' ELSE 'decrease' END AS direction
FROM P
""")
def group_premium(spark, sf):
    c = _coefs(_model_view(spark, sf))
    g = insight.group_premium(c, "sector_")
    return round_doubles(insight.per_std_effect(g))


@query("top_premiums", ops="L5 H3 E30", sql=M_SQL + """
, P AS (SELECT substring(feature, 9) AS label, coef FROM C WHERE starts_with(feature, 'society_'))
, Q AS (SELECT label, (exp(coef - avg(coef) OVER ()) - 1) * 100 AS premium_pct FROM P)
SELECT label, round(premium_pct, 6) AS premium_pct FROM Q ORDER BY premium_pct DESC, label LIMIT 10
""")
def top_premiums(spark, sf):
    c = _coefs(_model_view(spark, sf))
    g = insight.group_premium(c, "society_")
    top = insight.extremes_resorted(g, "premium_pct", 10, largest=True, tie="label")
    return round_doubles(top.select("label", "premium_pct"))
