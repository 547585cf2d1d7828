"""Registered queries: presence rates, score buckets, profiled items, price
requests (E29, E31, D7, J4, B21-B23, F2, F11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from acreage.functions import parse as P
from acreage.operators import features, stats
from acreage.plans import stages
from acreage.plans.bindings import L_SQL, listing_view, round_doubles, table
from acreage.plans.q_features import WEIGHTS_SQL, _rate_rows
from acreage.plans.q_parse import _furnish_text
from acreage.plans.q_similarity import _part_profiles
from acreage.plans.registry import query
from acreage.session import cut_lineage


@query("presence_rate", ops="E31", sql="""
WITH x AS (SELECT p_type, CASE WHEN p_size % 10 = 0 THEN 0 ELSE p_size % 5 END AS fan,
                  CASE WHEN p_size % 10 = 0 OR p_retailprice <= 950 THEN 0 ELSE 1 END AS fridge,
                  CASE WHEN p_size % 10 = 0 THEN 0 ELSE p_size % 3 + 1 END AS ac FROM part)
SELECT p_type, 'Fan' AS item, round(avg(CAST(fan > 0 AS DOUBLE)) * 100, 6) AS presence_pct,
       round(avg(fan), 6) AS mean_count FROM x GROUP BY p_type
UNION ALL SELECT p_type, 'Fridge', round(avg(CAST(fridge > 0 AS DOUBLE)) * 100, 6), round(avg(fridge), 6) FROM x GROUP BY p_type
UNION ALL SELECT p_type, 'AC', round(avg(CAST(ac > 0 AS DOUBLE)) * 100, 6), round(avg(ac), 6) FROM x GROUP BY p_type
""")
def presence_rate(spark, sf):
    p = table(spark, sf, "part").withColumn("details", P.clean_list_text(_furnish_text()))
    p = p.withColumns(P.item_counts("details", ["Fan", "Fridge", "AC"]))
    return round_doubles(stats.presence_rate(p, "p_type", ["Fan", "Fridge", "AC"]))


@query("score_buckets", ops="E29 G4 K1", sql="WITH " + WEIGHTS_SQL + """
, pw AS (SELECT p_partkey, unnest(list_distinct(string_split(p_name, ' '))) AS amenity FROM part)
, ls AS (SELECT part.p_partkey, any_value(part.p_retailprice) AS price, ln(1 + coalesce(sum(wt.weight), 0)) AS score
         FROM part LEFT JOIN pw ON part.p_partkey = pw.p_partkey LEFT JOIN wt ON pw.amenity = wt.amenity
         GROUP BY part.p_partkey)
, e AS (SELECT list_sort(list_distinct(quantile_cont(score, [0.0, 0.25, 0.5, 0.75, 1.0]))) AS edges FROM ls)
, b AS (SELECT greatest(len(list_filter(edges, lambda x: x < score)) - 1, 0) AS bucket, price FROM ls, e)
SELECT CAST(bucket AS INTEGER) AS bucket, count(*) AS count, round(avg(price), 6) AS mean,
       round(median(price), 6) AS median FROM b GROUP BY bucket
""")
def score_buckets(spark, sf):
    # edges, medians and the final read each go through the scores: weights and scores are computed once
    w = cut_lineage(features.amenity_weights(_rate_rows(spark, sf), "key", "features", "rate", 30))
    p = table(spark, sf, "part").select("p_partkey", "p_retailprice", F.split("p_name", " ").alias("features"))
    lux = features.luxury_score(p, "p_partkey", "features", w).join(p.select("p_partkey", "p_retailprice"), "p_partkey")
    return round_doubles(stats.score_buckets(cut_lineage(lux), "luxury_score", "p_retailprice", 4))


@query("profiled_items", ops="D7 J4", sql="""
WITH prof AS (SELECT l_partkey FROM lineitem GROUP BY l_partkey
              HAVING min(l_extendedprice) IS NOT NULL AND min(l_linenumber) IS NOT NULL)
SELECT p_type, count(*) AS n_profiled FROM part WHERE p_partkey IN (SELECT l_partkey FROM prof) GROUP BY p_type
""")
def profiled_items(spark, sf):
    prof = _part_profiles(spark, sf).dropna(subset=["min_price", "min_bhk"])
    keep = table(spark, sf, "part").join(prof.select("p_partkey"), "p_partkey", "left_semi")
    return keep.groupBy("p_type").agg(F.count(F.lit(1)).alias("n_profiled"))


@query("request_features", ops="B21 B22 B23 C10 F11", sql="WITH " + L_SQL + """
, soc AS (SELECT sector, society FROM (SELECT sector, society, row_number() OVER (PARTITION BY sector ORDER BY n DESC, society) rn
          FROM (SELECT sector, society, count(*) AS n FROM L WHERE society IS NOT NULL GROUP BY ALL)
          WHERE lower(society) <> 'other') WHERE rn = 1)
, r AS (SELECT order_key, line_no, sector, area * 300 + 100 AS total_area_sqft, bedrooms - 1 AS bedrooms FROM L)
SELECT r.order_key, r.line_no,
       (r.total_area_sqft > 100 AND r.total_area_sqft <= 15000 AND r.bedrooms BETWEEN 1 AND 10) AS is_valid,
       coalesce(soc.society, 'other') AS society,
       round(CASE WHEN r.bedrooms > 0 THEN r.total_area_sqft / r.bedrooms ELSE r.total_area_sqft END, 6) AS area_per_bedroom,
       0 AS plot_area_missing,
       CASE r.bedrooms % 3 WHEN 0 THEN 'Relatively New' WHEN 1 THEN 'Moderately Old' ELSE 'Under Construction' END
         AS age_possession
FROM r LEFT JOIN soc ON r.sector = soc.sector
""")
def request_features(spark, sf):
    L = listing_view(spark, sf)
    req = L.select("order_key", "line_no", "sector", F.lit("Flat").alias("property_type"),
                   (F.col("area") * 300 + 100).alias("total_area_sqft"), (F.col("bedrooms") - 1).alias("bedrooms"),
                   F.lit(1).alias("bathrooms"), F.lit(0).alias("servant_room"), F.lit(0).alias("pooja_room"),
                   F.lit(None).cast("string").alias("balcony"), F.lit(None).cast("string").alias("facing"),
                   F.element_at(F.array(F.lit("New"), F.lit("Old"), F.lit("Under Construction")),
                                (F.col("bedrooms") - 1) % 3 + 1).alias("age_label"))
    out = stages.request_features(req, L.select("sector", "society"))
    return round_doubles(out.select("order_key", "line_no", "is_valid", "society", "area_per_bedroom",
                                    "plot_area_missing", "age_possession"))


@query("clean_fields", ops="B3 B4 B5 B7 B6", sql="""
SELECT c_custkey,
  CAST(CAST(floor(abs(c_acctbal)) AS BIGINT) + 1000 AS DOUBLE) AS price_per_sqft,
  CAST(c_nationkey % 6 + 1 AS DOUBLE) AS bedrooms,
  CASE c_custkey % 3 WHEN 0 THEN '0' WHEN 1 THEN '2' ELSE '3+' END AS balcony,
  lower(trim(c_name)) AS society,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'not available' ELSE lower(c_mktsegment) END AS facing
FROM customer
""")
def clean_fields(spark, sf):
    c = table(spark, sf, "customer")
    rate_txt = F.concat(F.lit("₹"), F.format_number(F.floor(F.abs("c_acctbal")).cast("long") + 1000, 0), F.lit("/sqft"))
    beds_txt = F.concat((F.col("c_nationkey") % 6 + 1).cast("string"), F.lit(" Bedrooms"))
    bal_txt = F.element_at(F.array(F.lit("No Balcony"), F.lit("2 Balconies"), F.lit("3+ Balconies")),
                           (F.col("c_custkey") % 3 + 1).cast("int"))
    soc_txt = F.concat(F.lit("  "), F.upper("c_name"), F.lit(" "))
    facing = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"))
    return c.select("c_custkey", P.rate(rate_txt).alias("price_per_sqft"),
                    P.leading_number(beds_txt).alias("bedrooms"), P.balcony(bal_txt).alias("balcony"),
                    P.trim_lower(soc_txt).alias("society"), P.fill_lower(facing).alias("facing"))


@query("primary_area", ops="F2 F3 F5", sql="WITH " + L_SQL + """
, x AS (SELECT property_type, CASE property_type WHEN 'ECONOMY' THEN 'Flat' WHEN 'SMALL' THEN 'Independent Builder Floor'
                               WHEN 'LARGE' THEN 'Independent House' ELSE 'other' END AS kind,
               CASE WHEN bedrooms % 2 = 0 THEN area * 100 END AS super_a, CASE WHEN bedrooms % 3 = 0 THEN area * 90 END AS built_a,
               area * 80 AS carpet_a, CASE WHEN bedrooms > 4 THEN area * 120 END AS plot_a FROM L)
, y AS (SELECT property_type, CASE WHEN kind IN ('Flat', 'Independent Builder Floor') THEN super_a
                                   WHEN kind = 'Independent House' THEN plot_a END AS prim,
               list_sort(list_filter([super_a, built_a, carpet_a], lambda v: v IS NOT NULL)) AS a FROM x)
, z AS (SELECT property_type, coalesce(prim, CASE WHEN len(a) = 0 THEN NULL WHEN len(a) % 2 = 1 THEN a[len(a) // 2 + 1]
                                             ELSE (a[len(a) // 2] + a[len(a) // 2 + 1]) / 2 END) AS total FROM y)
SELECT property_type, count(total) AS n, round(sum(total), 6) AS total_area FROM z GROUP BY property_type
""")
def primary_area(spark, sf):
    from acreage.operators import impute
    L = listing_view(spark, sf)
    kind = (F.when(F.col("property_type") == "ECONOMY", "Flat").when(F.col("property_type") == "SMALL",
                                                                       "Independent Builder Floor")
             .when(F.col("property_type") == "LARGE", "Independent House").otherwise("other"))
    x = L.select("property_type", kind.alias("kind"),
                 F.when(F.col("bedrooms") % 2 == 0, (F.col("area") * 100).cast("string")).alias("super_a"),
                 F.when(F.col("bedrooms") % 3 == 0, F.col("area") * 90).alias("built_a"),
                 (F.col("area") * 80).alias("carpet_a"),
                 F.when(F.col("bedrooms") > 4, F.col("area") * 120).alias("plot_a"))
    x = impute.coerce_numeric(x, ["super_a"])           # F5: text -> double
    x = x.withColumn("total", impute.primary_area("kind", "super_a", "plot_a"))
    x = x.withColumn("total", impute.fallback_area("total", ["super_a", "built_a", "carpet_a"]))
    return round_doubles(x.groupBy("property_type").agg(F.count("total").alias("n"), F.sum("total").alias("total_area")))


@query("robust_scale", ops="K9", sql="""
WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS med,
                  quantile_cont(o_totalprice, 0.75) AS q3 FROM orders WHERE o_orderstatus = 'F')
SELECT o_orderstatus, count(*) AS n, round(sum((o_totalprice - med) / (q3 - q1)), 6) AS scaled_sum,
       round(min((o_totalprice - med) / (q3 - q1)), 6) AS scaled_min
FROM orders, q GROUP BY o_orderstatus
""")
def robust_scale(spark, sf):
    from acreage.ml.encode import robust_scale as rs
    o = table(spark, sf, "orders").select("o_orderstatus", "o_totalprice")
    s = rs(o, ["o_totalprice"], fit_on=o.where(F.col("o_orderstatus") == "F"))
    return round_doubles(s.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"),
                                                        F.sum("o_totalprice").alias("scaled_sum"),
                                                        F.min("o_totalprice").alias("scaled_min")))
