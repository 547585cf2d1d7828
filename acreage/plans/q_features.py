"""Registered queries: amenity features, clusters (2.G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from acreage.functions import parse as P
from acreage.operators import features
from acreage.operators.partitioning import dealt
from acreage.plans.bindings import round_doubles, table
from acreage.plans.q_parse import _furnish_text
from acreage.plans.registry import query


def _rate_rows(spark, sf):
    """Listing rows: one per lineitem, amenities = words of the part name,
    rate = price per unit."""
    li = table(spark, sf, "lineitem")
    p = table(spark, sf, "part")
    return li.join(p, li.l_partkey == p.p_partkey).select(
        F.col("l_orderkey").alias("key"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("rate"),
        F.split("p_name", " ").alias("features"))


WEIGHTS_SQL = """
r AS (SELECT l.l_extendedprice / l.l_quantity AS rate, list_distinct(string_split(p.p_name, ' ')) AS am
      FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)
, a AS (SELECT DISTINCT unnest(am) AS amenity FROM r)
, s AS (SELECT a.amenity, count(*) FILTER (WHERE list_contains(r.am, a.amenity)) AS n_present,
               median(rate) FILTER (WHERE list_contains(r.am, a.amenity)) AS median_present,
               median(rate) FILTER (WHERE NOT list_contains(r.am, a.amenity)) AS median_absent
        FROM a, r GROUP BY a.amenity)
, p AS (SELECT *, CASE WHEN n_present > 30 THEN greatest(median_present - median_absent, 0.0) ELSE 0.0 END AS premium
        FROM s)
, wt AS (SELECT *, CASE WHEN max(premium) OVER () > 0 THEN premium / max(premium) OVER () ELSE premium END AS weight
         FROM p)"""


@query("amenity_premium", ops="G3 G2", sql="WITH " + WEIGHTS_SQL + """
SELECT amenity, n_present, round(median_present, 6) AS median_present, round(median_absent, 6) AS median_absent,
       round(premium, 6) AS premium, round(weight, 6) AS weight FROM wt
""")
def amenity_premium(spark, sf):
    w = features.amenity_weights(_rate_rows(spark, sf), "key", "features", "rate", 30)
    return round_doubles(w)


@query("luxury_score", ops="G4", sql="WITH " + WEIGHTS_SQL + """
, pw AS (SELECT p_partkey, unnest(list_distinct(string_split(p_name, ' '))) AS amenity FROM part)
SELECT part.p_partkey AS p_partkey, round(ln(1 + coalesce(sum(wt.weight), 0)), 6) AS luxury_score
FROM part LEFT JOIN pw ON part.p_partkey = pw.p_partkey LEFT JOIN wt ON pw.amenity = wt.amenity
GROUP BY part.p_partkey
""")
def luxury_score(spark, sf):
    w = features.amenity_weights(_rate_rows(spark, sf), "key", "features", "rate", 30)
    p = table(spark, sf, "part").select("p_partkey", F.split("p_name", " ").alias("features"))
    return round_doubles(features.luxury_score(p, "p_partkey", "features", w))


@query("rarity_score", ops="G5", sql="""
WITH pw AS (SELECT p_partkey, unnest(list_distinct(string_split(p_name, ' '))) AS amenity FROM part)
, d AS (SELECT amenity, count(*) AS df FROM pw GROUP BY amenity)
, s AS (SELECT part.p_partkey, coalesce(sum(1.0 / d.df), 0.0) AS s FROM part LEFT JOIN pw ON part.p_partkey = pw.p_partkey
        LEFT JOIN d ON pw.amenity = d.amenity GROUP BY part.p_partkey)
SELECT p_partkey, round(CASE WHEN max(s) OVER () > min(s) OVER ()
       THEN (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) ELSE 0.0 END, 6) AS rarity_score FROM s
""")
def rarity_score(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.split("p_name", " ").alias("features"))
    return round_doubles(features.rarity_score(p, "p_partkey", "features"))


@query("tag_union", ops="G1 H5", sql="""
SELECT CASE o_orderstatus WHEN 'F' THEN 'Flat' WHEN 'O' THEN 'Independent House' ELSE 'Independent Builder Floor' END
       AS property_type, count(*) AS n, round(sum(o_totalprice), 4) AS total
FROM orders GROUP BY 1
""")
def tag_union(spark, sf):
    o = table(spark, sf, "orders")
    u = features.tag_union({"Flat": o.where(F.col("o_orderstatus") == "F"),
                            "Independent House": o.where(F.col("o_orderstatus") == "O"),
                            "Independent Builder Floor": o.where(~F.col("o_orderstatus").isin("F", "O"))})
    return round_doubles(u.groupBy("property_type").agg(F.count(F.lit(1)).alias("n"),
                                                        F.sum("o_totalprice").alias("total")), 4)


@query("furnish_clusters", ops="G6 B14 B15")
def furnish_clusters(spark, sf):
    part = table(spark, sf, "part")
    p = dealt(part).withColumn("details", P.clean_list_text(_furnish_text()))
    p = p.withColumns({k: c for k, c in P.item_counts("details", P.FURNISHING_ITEMS).items()})
    p = p.withColumn("known", F.col("details") != "No Info")
    model = features.FurnishClusters(P.FURNISHING_ITEMS, k=3, seed=42).fit(p)
    out = model.transform(p)
    return out.groupBy("furnishing_type").agg(F.count(F.lit(1)).alias("n"),
                                              F.avg("p_retailprice").alias("mean_price"))


@query("cluster_diagnostics", ops="G7")
def cluster_diagnostics(spark, sf):
    """Cost for k = 1..10 and silhouette for k = 2..8, each of the best of three starts."""
    from pyspark.ml.functions import array_to_vector

    from acreage.session import cut_lineage
    e = cut_lineage(table(spark, sf, "embeddings").select(array_to_vector("embedding").alias("features")))
    found = features.cluster_diagnostics(e, "features", list(range(1, 11)), inits=3)
    return found.withColumn("silhouette", F.when(F.col("k") <= 8, F.col("silhouette")))
