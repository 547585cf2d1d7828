"""Registered queries: market views and descriptive statistics (2.E, 2.C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from acreage.operators import stats, views
from acreage.plans.bindings import L_SQL, listing_view, round_doubles, table
from acreage.plans.registry import query

W = "WITH " + L_SQL


@query("price_dispersion", ops="E3 C7", sql=W + """
SELECT sector, round(quantile_cont(rate, 0.25), 4) AS p25, round(quantile_cont(rate, 0.75), 4) AS p75,
       count(rate) AS listings,
       round(quantile_cont(rate, 0.75) - quantile_cont(rate, 0.25), 4) AS iqr
FROM L GROUP BY sector HAVING count(rate) >= 15
""")
def price_dispersion(spark, sf):
    return round_doubles(views.dispersion(listing_view(spark, sf), "sector", "rate", 15), 4)


@query("market_mix", ops="E2 D4 I1", sql=W + """
SELECT sector, property_type, count(*) AS listing_count,
       CAST(sum(count(*)) OVER (PARTITION BY sector) AS BIGINT) AS total_listings,
       round(count(*) / sum(count(*)) OVER (PARTITION BY sector) * 100, 1) AS pct_of_sector
FROM L GROUP BY sector, property_type
""")
def market_mix(spark, sf):
    return views.mix(listing_view(spark, sf), "sector", "property_type")


@query("supply_by_sector", ops="E1 H1", sql=W + """
SELECT sector, count(*) AS n_listings FROM L GROUP BY sector
""")
def supply_by_sector(spark, sf):
    return views.supply(listing_view(spark, sf), "sector")


@query("config_matrix", ops="E4 C5", sql=W + """
, g AS (SELECT property_type, bedrooms, count(*) AS n FROM L WHERE bedrooms BETWEEN 1 AND 6 GROUP BY ALL)
, p AS (SELECT property_type, bedrooms, round(n / sum(n) OVER (PARTITION BY property_type) * 100, 1) AS pct FROM g)
SELECT property_type,
  coalesce(max(pct) FILTER (WHERE bedrooms = 1), 0.0) AS "1",
  coalesce(max(pct) FILTER (WHERE bedrooms = 2), 0.0) AS "2",
  coalesce(max(pct) FILTER (WHERE bedrooms = 3), 0.0) AS "3",
  coalesce(max(pct) FILTER (WHERE bedrooms = 4), 0.0) AS "4",
  coalesce(max(pct) FILTER (WHERE bedrooms = 5), 0.0) AS "5",
  coalesce(max(pct) FILTER (WHERE bedrooms = 6), 0.0) AS "6"
FROM p GROUP BY property_type
""")
def config_matrix(spark, sf):
    return views.config_matrix(listing_view(spark, sf), "property_type", "bedrooms", 1, 6)


@query("group_box_stats", ops="E5", sql=W + """
, q AS (SELECT property_type, count(price) AS n, quantile_cont(price, 0.25) AS q1,
               quantile_cont(price, 0.5) AS median, quantile_cont(price, 0.75) AS q3
        FROM L GROUP BY property_type)
, f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM q)
SELECT f.property_type, f.n, round(min(L.price), 6) AS min, round(f.q1, 6) AS q1, round(f.median, 6) AS median,
       round(f.q3, 6) AS q3, round(f.iqr, 6) AS iqr, round(f.lower_fence, 6) AS lower_fence,
       round(f.upper_fence, 6) AS upper_fence,
       round(min(L.price) FILTER (WHERE L.price BETWEEN f.lower_fence AND f.upper_fence), 6) AS whisker_lo,
       round(max(L.price) FILTER (WHERE L.price BETWEEN f.lower_fence AND f.upper_fence), 6) AS whisker_hi,
       CAST(sum(CASE WHEN L.price BETWEEN f.lower_fence AND f.upper_fence THEN 0 ELSE 1 END) AS BIGINT) AS n_outliers,
       round(max(L.price), 6) AS max
FROM f JOIN L ON L.property_type = f.property_type
GROUP BY f.property_type, f.n, f.q1, f.median, f.q3, f.iqr, f.lower_fence, f.upper_fence
""")
def group_box_stats(spark, sf):
    return round_doubles(stats.box(listing_view(spark, sf), "price", "property_type"))


@query("area_segments", ops="E6", sql=W + """
, s AS (SELECT rate, CASE WHEN area * 100 > 0 AND area * 100 <= 1000 THEN 'Small (<1000)'
                          WHEN area * 100 > 1000 AND area * 100 <= 2200 THEN 'Mid (1000–2200)'
                          WHEN area * 100 > 2200 AND area * 100 <= 3500 THEN 'Large (2200–3500)'
                          WHEN area * 100 > 3500 THEN 'Luxury (3500+)' END AS area_segment FROM L)
SELECT area_segment, count(*) AS n, round(avg(rate), 6) AS mean_rate, round(median(rate), 6) AS median_rate
FROM s WHERE area_segment IS NOT NULL GROUP BY area_segment
""")
def area_segments(spark, sf):
    L = listing_view(spark, sf).withColumn("sqft", F.col("area") * 100)
    seg = views.area_segments(L, "sqft").where(F.col("area_segment").isNotNull())
    out = stats.group_stats(seg, "rate", "area_segment", ("count", "mean", "median"))
    return round_doubles(out.withColumnsRenamed({"count": "n", "mean": "mean_rate", "median": "median_rate"}))


def _coords(spark, sf):
    """Sector coordinate dictionary derived from nation: text "lat° N, lon° E";
    the last nation's key carries a trailing blank (the dictionary trap)."""
    n = table(spark, sf, "nation")
    key = F.concat(F.col("n_name"), F.when(F.col("n_nationkey") == 24, F.lit(" ")).otherwise(F.lit("")))
    txt = F.format_string("%.2f° N, %.2f° E", F.lit(28.0) + F.col("n_nationkey") * 0.25,
                          F.lit(76.0) + F.col("n_regionkey") * 0.5)
    return n.select(key.alias("sector"), txt.alias("coordinates"))


COORDS_SQL = """
coords AS (SELECT n_name || CASE WHEN n_nationkey = 24 THEN ' ' ELSE '' END AS sector,
                  printf('%.2f° N, %.2f° E', 28.0 + n_nationkey * 0.25, 76.0 + n_regionkey * 0.5) AS coordinates
           FROM nation)"""


@query("geo_means", ops="E7 D2 A10", sql=W + "," + COORDS_SQL + """
, c AS (SELECT trim(sector) AS gk,
               TRY_CAST(trim(split_part(split_part(coordinates, ',', 1), '°', 1)) AS DOUBLE) AS latitude,
               TRY_CAST(trim(split_part(split_part(coordinates, ',', 2), '°', 1)) AS DOUBLE) AS longitude
        FROM coords)
SELECT L.sector, round(avg(rate), 6) AS rate, round(avg(area), 6) AS area,
       round(avg(latitude), 6) AS latitude, round(avg(longitude), 6) AS longitude
FROM L JOIN c ON trim(L.sector) = c.gk GROUP BY L.sector
""")
def geo_means(spark, sf):
    coords = views.parse_coordinates(_coords(spark, sf), "coordinates").drop("coordinates")
    j = views.geo_join(listing_view(spark, sf), coords, "sector", trim_keys=True)
    return round_doubles(views.geo_mean(j, "sector", ["rate", "area", "latitude", "longitude"]))


@query("amenity_frequency", ops="E8 A11", sql=W + """
SELECT amenity, count(*) AS n FROM (SELECT unnest(string_split(society, ' ')) AS amenity FROM L)
WHERE amenity IS NOT NULL GROUP BY amenity
""")
def amenity_frequency(spark, sf):
    L = listing_view(spark, sf).select(F.split("society", " ").alias("features"))
    return views.amenities(L, "features")


@query("word_frequency", ops="E9", sql="""
SELECT word, count(*) AS n
FROM (SELECT unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS word FROM documents)
WHERE word NOT IN ('s') GROUP BY word
""")
def word_frequency(spark, sf):
    return views.words(table(spark, sf, "documents"), "text", stop=("s",))


@query("describe_stats", ops="E15", sql="""
SELECT event_type, count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
       round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS q25,
       round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75,
       round(max(value), 6) AS max
FROM events GROUP BY event_type
""")
def describe_stats(spark, sf):
    return round_doubles(stats.describe(table(spark, sf, "events"), "value", "event_type"))


@query("shape_stats", ops="E16", sql=W + """
SELECT returnflag, count(price) AS n, round(skewness(price), 6) AS skew, round(kurtosis(price), 6) AS kurt
FROM L GROUP BY returnflag
""")
def shape_stats(spark, sf):
    return round_doubles(stats.shape(listing_view(spark, sf), "price", "returnflag"))


@query("quantile_table", ops="E17", sql=W + """
SELECT property_type, unnest([0.01, 0.05, 0.5, 0.95, 0.99]::DOUBLE[]) AS p,
       round(unnest(quantile_cont(price, [0.01, 0.05, 0.5, 0.95, 0.99])), 6) AS value
FROM L GROUP BY property_type
""")
def quantile_table(spark, sf):
    out = stats.quantile_table(listing_view(spark, sf), "price", [0.01, 0.05, 0.5, 0.95, 0.99], "property_type")
    return round_doubles(out)


PRICE_EDGES = [0, 1, 2, 3, 5, 10, 15, 20, 30, 35, 50]
PRICE_LABELS = ["0-1", "1-2", "2-3", "3-5", "5-10", "10-15", "15-20", "20-30", "30-35", "35-50"]


@query("price_bins", ops="E18", sql="""
WITH o AS (SELECT o_totalprice / 10000 AS v FROM orders)
, b AS (SELECT CASE
   WHEN v > 0 AND v <= 1 THEN 0 WHEN v > 1 AND v <= 2 THEN 1 WHEN v > 2 AND v <= 3 THEN 2
   WHEN v > 3 AND v <= 5 THEN 3 WHEN v > 5 AND v <= 10 THEN 4 WHEN v > 10 AND v <= 15 THEN 5
   WHEN v > 15 AND v <= 20 THEN 6 WHEN v > 20 AND v <= 30 THEN 7 WHEN v > 30 AND v <= 35 THEN 8
   WHEN v > 35 AND v <= 50 THEN 9 END AS bin_order FROM o)
, labels AS (SELECT * FROM (VALUES (0, '0-1'), (1, '1-2'), (2, '2-3'), (3, '3-5'), (4, '5-10'), (5, '10-15'),
              (6, '15-20'), (7, '20-30'), (8, '30-35'), (9, '35-50')) t(bin_order, bin))
, c AS (SELECT labels.bin_order, labels.bin, count(b.bin_order) AS count
        FROM labels LEFT JOIN b ON labels.bin_order = b.bin_order GROUP BY ALL)
SELECT bin_order, bin, count, round(count / sum(count) OVER () * 100, 6) AS percentage FROM c
""")
def price_bins(spark, sf):
    o = table(spark, sf, "orders").select((F.col("o_totalprice") / 10000).alias("price_in_cr"))
    return round_doubles(stats.cut_counts(o, "price_in_cr", PRICE_EDGES, PRICE_LABELS))


@query("histogram", ops="E19", sql="""
WITH b AS (SELECT least(CAST(floor((o_totalprice - 0) / 25000.0) AS INTEGER), 19) AS bin
           FROM orders WHERE o_totalprice BETWEEN 0 AND 500000),
bins AS (SELECT CAST(range AS INTEGER) AS bin FROM range(20)),
c AS (SELECT bins.bin, count(b.bin) AS count FROM bins LEFT JOIN b ON bins.bin = b.bin GROUP BY bins.bin)
SELECT bin, CAST(round(0 + bin * 25000.0, 6) AS DOUBLE) AS bin_lo, CAST(round(0 + (bin + 1) * 25000.0, 6) AS DOUBLE) AS bin_hi, count,
       round(count / (sum(count) OVER () * 25000.0), 12) AS density
FROM c
""")
def histogram(spark, sf):
    h = stats.histogram(table(spark, sf, "orders"), "o_totalprice", 0.0, 500000.0, 20)
    return h.select("bin", F.round("bin_lo", 6).alias("bin_lo"), F.round("bin_hi", 6).alias("bin_hi"),
                    "count", F.round("density", 12).alias("density"))


@query("ecdf", ops="E20 I3", sql="""
WITH v AS (SELECT o_totalprice AS value, count(*) AS count FROM orders WHERE o_totalprice IS NOT NULL GROUP BY 1)
SELECT value, count, CAST(sum(count) OVER (ORDER BY value) AS BIGINT) AS cum_count,
       round(sum(count) OVER (ORDER BY value) / (SELECT count(*) FROM orders), 9) AS ecdf
FROM v
""")
def ecdf(spark, sf):
    e = stats.ecdf(table(spark, sf, "orders"), "o_totalprice")
    return e.withColumn("ecdf", F.round("ecdf", 9))


BANDS = [("Very High (>100)", 101, None), ("High (50-100)", 50, 100), ("Average (10-49)", 10, 49),
         ("Low (2-9)", 2, 9), ("Very Low (1)", 1, 1)]


@query("cardinality_bands", ops="E21", sql="""
WITH f AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1)
SELECT * FROM (VALUES
  (0, 'Very High (>100)', (SELECT count(*) FROM f WHERE n >= 101)),
  (1, 'High (50-100)', (SELECT count(*) FROM f WHERE n BETWEEN 50 AND 100)),
  (2, 'Average (10-49)', (SELECT count(*) FROM f WHERE n BETWEEN 10 AND 49)),
  (3, 'Low (2-9)', (SELECT count(*) FROM f WHERE n BETWEEN 2 AND 9)),
  (4, 'Very Low (1)', (SELECT count(*) FROM f WHERE n = 1))) t(band_order, band, n_keys)
""")
def cardinality_bands(spark, sf):
    return stats.cardinality_bands(table(spark, sf, "orders"), "o_custkey", BANDS)


def _listing_with_nulls(spark, sf):
    """L with nulls made by rule (the driver tables have none)."""
    L = listing_view(spark, sf)
    return L.select(
        "order_key", "line_no", "property_type", "society", "price", "rate", "bedrooms",
        F.when(F.col("sector") != "NATION_3", F.col("sector")).alias("sector"),
        F.when(F.col("bedrooms") != 7, F.col("area")).alias("area"),
        F.when(F.col("size") % 10 != 0, F.col("discount")).alias("discount"),
        F.when(F.col("returnflag") != "R", F.col("tax")).alias("tax"))


NULLS_SQL = """
LN AS (SELECT order_key, line_no, property_type, society, price, rate, bedrooms,
              CASE WHEN sector <> 'NATION_3' THEN sector END AS sector,
              CASE WHEN bedrooms <> 7 THEN area END AS area,
              CASE WHEN size % 10 <> 0 THEN discount END AS discount,
              CASE WHEN returnflag <> 'R' THEN tax END AS tax FROM L)"""


@query("missing_summary", ops="E22", sql=W + "," + NULLS_SQL + """
SELECT "column", n_null, round(n_null / (SELECT count(*) FROM LN) * 100, 6) AS null_pct FROM (VALUES
 ('sector', (SELECT count(*) FROM LN WHERE sector IS NULL)),
 ('area', (SELECT count(*) FROM LN WHERE area IS NULL)),
 ('discount', (SELECT count(*) FROM LN WHERE discount IS NULL)),
 ('tax', (SELECT count(*) FROM LN WHERE tax IS NULL)),
 ('price', (SELECT count(*) FROM LN WHERE price IS NULL))) t("column", n_null)
""")
def missing_summary(spark, sf):
    return stats.missing(_listing_with_nulls(spark, sf), ["sector", "area", "discount", "tax", "price"])


@query("duplicates", ops="E23 H6", sql="""
SELECT count(*) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT text FROM documents)) AS n_distinct,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT text FROM documents)) AS n_duplicates
FROM documents
""")
def duplicates(spark, sf):
    return stats.duplicates(table(spark, sf, "documents"), ["text"])


PROFILED = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
            "o_orderpriority": "string"}


def profile_sql(c: str, kind: str) -> str:
    """One column's row of the profile."""
    number = kind != "string"
    mean = f"round(avg({c}), 6)" if number else "CAST(NULL AS DOUBLE)"
    quantile = "; ".join(["%.2f"] * 5)
    q = f"printf('{quantile}', " + ", ".join(f"round(quantile_cont({c}, {p}), 2)" for p in (0.05, 0.25, 0.5, 0.75, 0.95)) + ")" if number else "CAST(NULL AS VARCHAR)"
    return f"""SELECT '{c}' AS column, '{kind}' AS dtype, count(*) AS n_rows, count(*) FILTER (WHERE {c} IS NULL) AS n_null,
       count(DISTINCT {c}) AS n_distinct, CAST(min({c}) AS VARCHAR) AS min, CAST(max({c}) AS VARCHAR) AS max,
       {mean} AS mean, {q} AS quantiles,
       (SELECT coalesce(string_agg(v || '=' || n, '; ' ORDER BY n DESC, v), '')
        FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM orders WHERE {c} IS NOT NULL GROUP BY 1
              HAVING count(*) >= greatest(ceil(0.005 * (SELECT count(*) FROM orders)), 1) ORDER BY n DESC, v LIMIT 5)) AS top
FROM orders"""


@query("profile", ops="E28", sql=" UNION ALL ".join(profile_sql(c, kind) for c, kind in PROFILED.items()))
def profile(spark, sf):
    out = round_doubles(stats.profile(table(spark, sf, "orders"), list(PROFILED)))
    quantile = F.transform("quantiles", lambda x: F.format_string("%.2f", F.round(x, 2)))
    return out.withColumn("quantiles", F.array_join(quantile, "; ")).withColumn(
        "top", F.array_join(F.transform("top", lambda x: F.concat_ws("=", x["value"], x["n"].cast("string"))), "; "))


CORR_COLS = ["price", "area", "rate", "bedrooms", "discount", "tax"]


def _corr_sql():
    parts = []
    for a in CORR_COLS:
        for b in CORR_COLS:
            v = (f"round(corr({a}, {b}), 6)" if a != b else
                 f"CASE WHEN stddev_samp({a}) > 0 THEN 1.0 END")
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {v} AS corr FROM L")
    return W + "\n" + "\nUNION ALL\n".join(parts)


@query("corr_matrix", ops="E24", sql=_corr_sql())
def corr_matrix(spark, sf):
    return round_doubles(stats.corr_matrix(listing_view(spark, sf), CORR_COLS))


TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query("crosstab", ops="E13", sql=W + """
SELECT sector, """ + ",\n".join(
    f"count(*) FILTER (WHERE property_type = '{t}') AS \"{t}\"" for t in TYPES) + """
FROM L GROUP BY sector
""")
def crosstab(spark, sf):
    return stats.crosstab(listing_view(spark, sf), "sector", "property_type", TYPES)


@query("pivot_price", ops="E14", sql=W + """
, m AS (SELECT property_type, returnflag, quantile_cont(price, 0.5) AS med FROM L GROUP BY ALL)
SELECT property_type,
  round(max(med) FILTER (WHERE returnflag = 'A'), 6) AS "A",
  round(max(med) FILTER (WHERE returnflag = 'N'), 6) AS "N",
  round(max(med) FILTER (WHERE returnflag = 'R'), 6) AS "R"
FROM m GROUP BY property_type
""")
def pivot_price(spark, sf):
    p = stats.pivot(listing_view(spark, sf), "property_type", "returnflag", "price", "median", ["A", "N", "R"])
    return round_doubles(p)


@query("sector_options", ops="E10 H6", sql=W + """
SELECT 'All' AS option UNION ALL SELECT DISTINCT CAST(sector AS VARCHAR) FROM L WHERE sector IS NOT NULL
""")
def sector_options(spark, sf):
    return views.options(listing_view(spark, sf), "sector")


@query("bedroom_share", ops="E11 H2", sql=W + """
SELECT bedrooms, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 2) AS share
FROM L WHERE bedrooms IS NOT NULL GROUP BY bedrooms ORDER BY n DESC, bedrooms LIMIT 5
""")
def bedroom_share(spark, sf):
    return views.share(listing_view(spark, sf), "bedrooms", top=5)


@query("group_medians", ops="E12", sql=W + """
SELECT property_type, round(avg(price), 6) AS mean, round(quantile_cont(price, 0.5), 6) AS median
FROM L GROUP BY property_type
""")
def group_medians(spark, sf):
    return round_doubles(stats.group_stats(listing_view(spark, sf), "price", "property_type", ("mean", "median")))
