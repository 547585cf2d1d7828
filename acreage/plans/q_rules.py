"""Registered queries: filters, validation, imputation, binning (2.C, 2.F, K1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from acreage.operators import impute, rules, views
from acreage.plans.bindings import L_SQL, listing_view, round_doubles, table
from acreage.plans.q_views import NULLS_SQL, _listing_with_nulls
from acreage.plans.registry import query

W = "WITH " + L_SQL


@query("iqr_outliers", ops="C8", sql=W + """
, q AS (SELECT quantile_cont(rate, 0.25) AS q1, quantile_cont(rate, 0.75) AS q3 FROM L)
, f AS (SELECT k_lo, k_hi, q1 - k_lo * (q3 - q1) AS lower_fence, q3 + k_hi * (q3 - q1) AS upper_fence
        FROM q, (VALUES (1.5, 1.5), (1.5, 3.0)) k(k_lo, k_hi))
SELECT CAST(k_lo AS DOUBLE) AS k_lo, CAST(k_hi AS DOUBLE) AS k_hi, round(lower_fence, 6) AS lower_fence,
       round(upper_fence, 6) AS upper_fence,
       count(*) FILTER (WHERE rate < lower_fence OR rate > upper_fence) AS n_outliers,
       round(avg(rate) FILTER (WHERE rate < lower_fence OR rate > upper_fence), 6) AS mean_outlier,
       round(min(rate) FILTER (WHERE rate < lower_fence OR rate > upper_fence), 6) AS min_outlier,
       round(max(rate) FILTER (WHERE rate < lower_fence OR rate > upper_fence), 6) AS max_outlier
FROM f, L GROUP BY k_lo, k_hi, lower_fence, upper_fence
""")
def iqr_outliers(spark, sf):
    L = listing_view(spark, sf).select("rate")
    outs = []
    for k_lo, k_hi in ((1.5, 1.5), (1.5, 3.0)):
        f = rules.iqr_flag(L, "rate", k_lo, k_hi)
        o = F.col("is_outlier")
        outs.append(f.groupBy("lower_fence", "upper_fence").agg(
            F.sum(o.cast("long")).alias("n_outliers"),
            F.avg(F.when(o, F.col("rate"))).alias("mean_outlier"),
            F.min(F.when(o, F.col("rate"))).alias("min_outlier"),
            F.max(F.when(o, F.col("rate"))).alias("max_outlier"))
            .select(F.lit(k_lo).alias("k_lo"), F.lit(k_hi).alias("k_hi"), "*"))
    return round_doubles(outs[0].unionByName(outs[1]))


@query("ratio_filter", ops="C4 G8", sql=W + """
, r AS (SELECT bedrooms, area * 100 / bedrooms AS ratio FROM L)
SELECT bedrooms, count(*) AS n_kept FROM r
WHERE ratio >= 200 AND NOT (bedrooms >= 7 AND ratio < 300) GROUP BY bedrooms
""")
def ratio_filter(spark, sf):
    L = listing_view(spark, sf).withColumn("sqft", F.col("area") * 100)
    kept = rules.apply(L, {"ratio": rules.ratio_rule("sqft", "bedrooms")})
    return kept.groupBy("bedrooms").agg(F.count(F.lit(1)).alias("n_kept"))


def _report_rules():
    return {
        "require_price_rate": rules.require(["price", "rate"]),
        "area_cap": rules.cap("sqft", 4000),
        "rate_cap": rules.cap("rate", 20000),
        "ratio": rules.ratio_rule("sqft", "bedrooms"),
    }


@query("rule_report", ops="C11 C1 C2 C3", sql=W + "," + NULLS_SQL + """
, x AS (SELECT *, area * 100 AS sqft FROM LN)
, f AS (SELECT NOT (price IS NOT NULL AND rate IS NOT NULL) AS f0,
               NOT coalesce(sqft <= 4000, false) AS f1,
               NOT coalesce(rate <= 20000, false) AS f2,
               NOT coalesce(sqft / bedrooms >= 200 AND NOT (bedrooms >= 7 AND sqft / bedrooms < 300), false) AS f3
        FROM x)
, a AS (SELECT count(*) AS n,
   sum(f0::INT) AS fa0, sum(f1::INT) AS fa1, sum(f2::INT) AS fa2, sum(f3::INT) AS fa3,
   sum(f0::INT) AS r0, sum((f1 AND NOT f0)::INT) AS r1, sum((f2 AND NOT (f0 OR f1))::INT) AS r2,
   sum((f3 AND NOT (f0 OR f1 OR f2))::INT) AS r3,
   sum((f0 AND NOT (f1 OR f2 OR f3))::INT) AS o0, sum((f1 AND NOT (f0 OR f2 OR f3))::INT) AS o1,
   sum((f2 AND NOT (f0 OR f1 OR f3))::INT) AS o2, sum((f3 AND NOT (f0 OR f1 OR f2))::INT) AS o3 FROM f)
SELECT 0 AS rule_order, 'require_price_rate' AS rule, n AS n_before, fa0::BIGINT AS n_failed, r0::BIGINT AS n_removed,
       o0::BIGINT AS n_only, (n - r0)::BIGINT AS n_after FROM a
UNION ALL SELECT 1, 'area_cap', (n - r0)::BIGINT, fa1::BIGINT, r1::BIGINT, o1::BIGINT, (n - r0 - r1)::BIGINT FROM a
UNION ALL SELECT 2, 'rate_cap', (n - r0 - r1)::BIGINT, fa2::BIGINT, r2::BIGINT, o2::BIGINT, (n - r0 - r1 - r2)::BIGINT FROM a
UNION ALL SELECT 3, 'ratio', (n - r0 - r1 - r2)::BIGINT, fa3::BIGINT, r3::BIGINT, o3::BIGINT,
          (n - r0 - r1 - r2 - r3)::BIGINT FROM a
""")
def rule_report(spark, sf):
    x = _listing_with_nulls(spark, sf).withColumn("sqft", F.col("area") * 100)
    return rules.report(x, _report_rules())


def _requests(spark, sf):
    """Price requests derived from L by rule (types, areas, rooms, flags)."""
    L = listing_view(spark, sf)
    ptype = (F.when(F.col("property_type").isin("ECONOMY", "SMALL"), F.lit("Flat"))
              .when(F.col("property_type").isin("LARGE", "MEDIUM"), F.lit("Independent House"))
              .when(F.col("property_type") == "PROMO", F.lit("Independent Builder Floor"))
              .otherwise(F.lower("property_type")))
    return L.select(
        "order_key", "line_no",
        ptype.alias("property_type"),
        (F.col("area") * 300 + 100).alias("total_area_sqft"),
        (F.col("bedrooms") + F.col("size") % 5 - 1).alias("bedrooms"),
        (F.col("size") % 12).alias("bathrooms"),
        (F.col("supp_key") % 3).cast("int").alias("servant_room"),
        F.when(F.col("returnflag") == "R", F.lit(None).cast("int")).otherwise(F.lit(1)).alias("pooja_room"),
        F.element_at(F.array(*map(F.lit, ["Furnished", "semifurnished", "Unfurnished"])), (F.col("part_key") % 3 + 1).cast("int")).alias("furnishing_type"),
        F.when(F.col("size") % 4 != 0, F.element_at(F.array(*map(F.lit, ["New Property", "Old Property", "New"])), (F.col("size") % 3 + 1).cast("int"))).alias("age_possession"),
        F.when(F.col("linestatus") == "O", F.lit("Luxury")).when(F.col("line_no") == 7, F.lit("Top")).alias("luxury_category"))


@query("request_validation", ops="C10", sql=W + """
, r AS (SELECT order_key, line_no,
          CASE WHEN property_type IN ('ECONOMY', 'SMALL') THEN 'Flat' WHEN property_type IN ('LARGE', 'MEDIUM') THEN 'Independent House'
               WHEN property_type = 'PROMO' THEN 'Independent Builder Floor' ELSE lower(property_type) END AS property_type,
          area * 300 + 100 AS total_area_sqft,
          bedrooms + size % 5 - 1 AS bedrooms, size % 12 AS bathrooms, CAST(supp_key % 3 AS INTEGER) AS servant_room,
          coalesce(CASE WHEN returnflag = 'R' THEN NULL ELSE 1 END, 0) AS pooja_room,
          ['Furnished', 'semifurnished', 'Unfurnished'][part_key % 3 + 1] AS furnishing_type,
          CASE WHEN size % 4 <> 0 THEN ['New Property', 'Old Property', 'New'][size % 3 + 1] ELSE 'Relatively New' END AS age_possession,
          CASE WHEN linestatus = 'O' THEN 'Luxury' WHEN line_no = 7 THEN 'Top' ELSE 'Budget' END AS luxury_category FROM L)
, v AS (SELECT order_key, line_no, concat_ws(',',
          CASE WHEN property_type NOT IN ('Flat', 'Independent House', 'Independent Builder Floor') THEN 'property_type' END,
          CASE WHEN NOT (total_area_sqft > 100 AND total_area_sqft <= 15000) THEN 'total_area_sqft' END,
          CASE WHEN NOT (bedrooms BETWEEN 1 AND 10) THEN 'bedrooms' END,
          CASE WHEN NOT (bathrooms BETWEEN 1 AND 10) THEN 'bathrooms' END,
          CASE WHEN servant_room NOT IN (0, 1) THEN 'servant_room' END,
          CASE WHEN pooja_room NOT IN (0, 1) THEN 'pooja_room' END,
          CASE WHEN furnishing_type NOT IN ('Furnished', 'Semi-Furnished', 'Unfurnished') THEN 'furnishing_type' END,
          CASE WHEN age_possession NOT IN ('New Property', 'Relatively New', 'Moderately Old', 'Old Property', 'Under Construction', 'Undefined') THEN 'age_possession' END,
          CASE WHEN luxury_category NOT IN ('Budget', 'Semi-Luxury', 'Luxury') THEN 'luxury_category' END) AS reasons FROM r)
SELECT order_key, line_no, reasons = '' AS is_valid, reasons FROM v
""")
def request_validation(spark, sf):
    v = rules.validate(_requests(spark, sf), rules.request_spec(), defaults=rules.REQUEST_DEFAULTS)
    return v.select("order_key", "line_no", "is_valid", F.array_join("invalid_reasons", ",").alias("reasons"))


def _ages(spark, sf):
    x = _listing_with_nulls(spark, sf)
    return x.withColumn("age", F.when(F.col("bedrooms") >= 6, F.lit("Undefined")).otherwise(
        F.when(F.col("bedrooms") == 5, F.lit("Resale")).otherwise(F.concat(F.lit("flag "), F.col("order_key") % 3))))


@query("mode_impute", ops="F8", sql=W + "," + NULLS_SQL + """
, a0 AS (SELECT sector, property_type,
           CASE WHEN bedrooms >= 6 THEN 'Undefined' WHEN bedrooms = 5 THEN 'Resale'
                ELSE 'flag ' || CAST(order_key % 3 AS VARCHAR) END AS age FROM LN)
, m1 AS (SELECT sector, property_type, age AS m FROM (
           SELECT sector, property_type, age, row_number() OVER (PARTITION BY sector, property_type
                  ORDER BY count(*) DESC, age) AS rn
           FROM a0 WHERE sector IS NOT NULL AND property_type IS NOT NULL AND age IS NOT NULL
           GROUP BY sector, property_type, age) WHERE rn = 1)
, a1 AS (SELECT a0.sector, a0.property_type,
           CASE WHEN a0.age = 'Undefined' AND m1.m IS NOT NULL THEN m1.m ELSE a0.age END AS age
         FROM a0 LEFT JOIN m1 ON a0.sector = m1.sector AND a0.property_type = m1.property_type)
, m2 AS (SELECT sector, age AS m FROM (
           SELECT sector, age, row_number() OVER (PARTITION BY sector ORDER BY count(*) DESC, age) AS rn
           FROM a1 WHERE sector IS NOT NULL AND age IS NOT NULL GROUP BY sector, age) WHERE rn = 1)
, a2 AS (SELECT a1.sector, a1.property_type,
           CASE WHEN a1.age = 'Undefined' AND m2.m IS NOT NULL THEN m2.m ELSE a1.age END AS age
         FROM a1 LEFT JOIN m2 ON a1.sector = m2.sector)
, m3 AS (SELECT property_type, age AS m FROM (
           SELECT property_type, age, row_number() OVER (PARTITION BY property_type ORDER BY count(*) DESC, age) AS rn
           FROM a2 WHERE property_type IS NOT NULL AND age IS NOT NULL GROUP BY property_type, age) WHERE rn = 1)
, a3 AS (SELECT a2.sector, a2.property_type,
           CASE WHEN a2.age = 'Undefined' AND m3.m IS NOT NULL THEN m3.m ELSE a2.age END AS age
         FROM a2 LEFT JOIN m3 ON a2.property_type = m3.property_type)
SELECT sector, property_type, age, count(*) AS n FROM a3 GROUP BY ALL
""")
def mode_impute(spark, sf):
    d = impute.mode_fill(_ages(spark, sf), "age", "Undefined")
    return d.groupBy("sector", "property_type", "age").agg(F.count(F.lit(1)).alias("n"))


@query("median_fill", ops="F6", sql=W + "," + NULLS_SQL + """
, m AS (SELECT quantile_cont(area, 0.5) AS med FROM LN)
SELECT bedrooms, count(*) AS n, round(avg(coalesce(area, med)), 6) AS mean_area FROM LN, m GROUP BY bedrooms
""")
def median_fill(spark, sf):
    d = impute.median_fill(_listing_with_nulls(spark, sf), "area")
    return round_doubles(d.groupBy("bedrooms").agg(F.count(F.lit(1)).alias("n"), F.avg("area").alias("mean_area")))


@query("mean_fill", ops="F7", sql=W + "," + NULLS_SQL + """
, m AS (SELECT avg(discount) AS md, avg(tax) AS mt FROM LN)
SELECT property_type, round(sum(coalesce(discount, md)), 6) AS discount, round(sum(coalesce(tax, mt)), 6) AS tax
FROM LN, m GROUP BY property_type
""")
def mean_fill(spark, sf):
    d = impute.mean_fill(_listing_with_nulls(spark, sf), ["discount", "tax"])
    return round_doubles(d.groupBy("property_type").agg(F.sum("discount").alias("discount"), F.sum("tax").alias("tax")))


@query("rare_cap", ops="F9", sql="""
WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS customer FROM orders)
, c AS (SELECT customer, count(*) AS cnt FROM o GROUP BY customer)
SELECT CASE WHEN c.cnt < 5 THEN 'Other' ELSE o.customer END AS customer, count(*) AS n
FROM o JOIN c USING (customer) GROUP BY 1
""")
def rare_cap(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("customer"))
    return impute.cap_rare(o, "customer", 5).groupBy("customer").agg(F.count(F.lit(1)).alias("n"))


@query("row_median", ops="F3 F1 F4", sql=W + "," + NULLS_SQL + """
, x AS (SELECT bedrooms, list_sort(list_filter([area, discount * 1000, tax * 1000], lambda v: v IS NOT NULL)) AS a,
               area IS NULL AS am, greatest(coalesce(area, 0), coalesce(discount * 1000, 0), coalesce(tax * 1000, 0)) AS mx
        FROM LN)
, y AS (SELECT bedrooms, am, mx, CASE WHEN len(a) = 0 THEN NULL WHEN len(a) % 2 = 1 THEN a[len(a) // 2 + 1]
               ELSE (a[len(a) // 2] + a[len(a) // 2 + 1]) / 2 END AS med FROM x)
SELECT bedrooms, count(med) AS n_med, round(sum(med), 6) AS sum_med, CAST(sum(am::INT) AS BIGINT) AS n_area_missing,
       round(sum(mx), 6) AS sum_max FROM y GROUP BY bedrooms
""")
def row_median(spark, sf):
    x = _listing_with_nulls(spark, sf).withColumns({"d1000": F.col("discount") * 1000, "t1000": F.col("tax") * 1000})
    x = impute.missing_flags(x, ["area"])
    x = x.withColumn("med", impute.row_median(["area", "d1000", "t1000"])).withColumn(
        "mx", impute.max_area(["area", "d1000", "t1000"]))
    return round_doubles(x.groupBy("bedrooms").agg(
        F.count("med").alias("n_med"), F.sum("med").alias("sum_med"),
        F.sum("area_missing").cast("long").alias("n_area_missing"), F.sum("mx").alias("sum_max")))


@query("default_category", ops="F11 I5", sql=W + """
, x AS (SELECT sector, CASE WHEN size < 5 OR society LIKE 'hot%' THEN 'Other' ELSE society END AS society FROM L)
, c AS (SELECT sector, society, count(*) AS n FROM x WHERE society IS NOT NULL GROUP BY ALL)
, b AS (SELECT sector, society FROM (SELECT sector, society, row_number() OVER (PARTITION BY sector ORDER BY n DESC, society) rn
        FROM c WHERE lower(society) <> 'other') WHERE rn = 1)
SELECT g.sector, coalesce(b.society, 'other') AS default_society
FROM (SELECT DISTINCT sector FROM c) g LEFT JOIN b ON g.sector = b.sector
""")
def default_category(spark, sf):
    L = listing_view(spark, sf)
    x = L.withColumn("society", F.when((F.col("size") < 5) | F.col("society").startswith("hot"), F.lit("Other"))
                     .otherwise(F.col("society")))
    return views.default_category(x, "sector", "society", skip="other")


@query("floor_band", ops="F10 B10", sql=W + """
, x AS (SELECT CASE WHEN bedrooms = 7 THEN NULL ELSE size % 25 - 1 END AS floornum FROM L)
SELECT CASE WHEN floornum IS NULL THEN 'Undefined' WHEN floornum <= 5 THEN 'Low-rise'
            WHEN floornum <= 15 THEN 'Mid-rise' ELSE 'High-rise' END AS floornum_category, count(*) AS n
FROM x GROUP BY 1
""")
def floor_band(spark, sf):
    L = listing_view(spark, sf)
    # Floor text built by rule, parsed back with the floor parser.
    from acreage.functions.parse import floor_num
    f = F.col("size") % 25 - 1
    txt = (F.when(F.col("bedrooms") == 7, F.lit(None))
            .when(f == -1, F.lit("Lower Ground of 3 Floors")).when(f == 0, F.lit("Ground of 4 Floors"))
            .otherwise(F.concat(f.cast("string"), F.lit("th of 30 Floors"))))
    x = L.select(floor_num(txt).alias("floornum"))
    return x.groupBy(impute.floor_band("floornum").alias("floornum_category")).agg(F.count(F.lit(1)).alias("n"))


@query("qcut_bins", ops="K1 I4", sql="""
WITH e AS (SELECT list_sort(list_distinct(quantile_cont(o_totalprice, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS edges FROM orders)
, b AS (SELECT o_totalprice AS v, greatest(len(list_filter(edges, lambda x: x < o_totalprice)) - 1, 0) AS code, edges
        FROM orders, e WHERE o_totalprice >= edges[1] AND o_totalprice <= edges[len(edges)])
SELECT CASE WHEN len(edges) - 1 = 5 THEN ['very low', 'low', 'mid', 'high', 'very high'][code + 1]
            ELSE 'bin_' || code END AS bin, CAST(code AS INTEGER) AS bin_code,
       count(*) AS n, round(min(v), 6) AS min_v, round(max(v), 6) AS max_v
FROM b GROUP BY ALL
""")
def qcut_bins(spark, sf):
    o = table(spark, sf, "orders")
    b = impute.qcut(o, "o_totalprice", 5, ["very low", "low", "mid", "high", "very high"])
    return round_doubles(b.where(F.col("bin").isNotNull()).groupBy("bin", "bin_code").agg(
        F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("min_v"), F.max("o_totalprice").alias("max_v")))
