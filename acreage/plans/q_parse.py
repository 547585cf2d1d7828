"""Registered queries: text parsers (2.B) and literal decoding.

Each Spark query *builds* listing-style text from numeric columns of the
driver tables by a fixed rule and parses it back with :mod:`acreage.functions.parse`.
The oracle SQL does not parse text: it computes the expected values straight
from the same numeric columns, so it checks the parsers independently.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from acreage.functions import parse as P
from acreage.operators.partitioning import spread
from acreage.plans.bindings import L_SQL, listing_view, round_doubles, table
from acreage.plans.registry import query

W = "WITH " + L_SQL


def _price_text():
    k = F.floor("o_totalprice")
    cr = F.concat(F.lit("₹"), (k / 100000).cast("long").cast("string"), F.lit("."),
                  F.lpad(((k / 1000).cast("long") % 100).cast("string"), 2, "0"), F.lit(" Cr"))
    lac = F.concat(F.lit("₹"), (k / 1000).cast("long").cast("string"), F.lit(" Lac"))
    return (F.when(F.col("o_orderpriority") == "5-LOW", F.lit("Price on Request"))
             .when((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT"), F.lit("₹abc"))
             .when(k >= 100000, cr).otherwise(lac))


@query("parse_price", ops="B1 B2 C9", sql="""
WITH o AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, CAST(floor(o_totalprice) AS BIGINT) AS k FROM orders)
SELECT o_orderkey,
  CASE WHEN o_orderpriority = '5-LOW' THEN NULL
       WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN NULL
       ELSE round((k // 1000) / 100.0, 2) END AS price_in_cr,
  (o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' AND o_orderpriority <> '5-LOW') AS is_bad,
  o_orderpriority <> '5-LOW' AS kept
FROM o
""")
def parse_price(spark, sf):
    o = table(spark, sf, "orders").withColumn("price", _price_text())
    o = o.withColumnsRenamed({"price": "price_text"})
    return o.select("o_orderkey", P.price_cr("price_text").alias("price_in_cr"),
                    P.is_bad_price("price_text").alias("is_bad"),
                    F.coalesce(F.col("price_text") != "Price on Request", F.lit(True)).alias("kept"))


def _area_text():
    sqft = F.floor(F.col("l_extendedprice") / 10).cast("long")
    n = F.col("l_linenumber")
    kind = (F.when(n <= 2, F.lit("Super Built-up Area")).when(n <= 4, F.lit("Built-up Area"))
             .when(n == 5, F.lit("Carpet Area")).otherwise(F.lit("Plot Area")))
    main = F.concat(F.format_number(sqft, 0), F.lit(" sqft ("), (sqft / 10).cast("long").cast("string"),
                    F.lit(" sqm) "), kind)
    half = (sqft / 2).cast("long")
    extra = F.concat(F.lit(" "), F.format_number(half, 0), F.lit(" sqft ("), (half / 10).cast("long").cast("string"),
                     F.lit(" sqm) Carpet Area"))
    return F.when(n == 1, F.concat(main, extra)).otherwise(main)


@query("parse_areas", ops="B11", sql="""
WITH x AS (SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice / 10) AS BIGINT) AS sqft FROM lineitem)
SELECT l_orderkey, l_linenumber,
  CASE WHEN l_linenumber <= 2 THEN CAST(sqft AS DOUBLE) END AS super_built_up_area,
  CASE WHEN l_linenumber IN (3, 4) THEN CAST(sqft AS DOUBLE) END AS built_up_area,
  CASE WHEN l_linenumber = 5 THEN CAST(sqft AS DOUBLE) WHEN l_linenumber = 1 THEN CAST(sqft // 2 AS DOUBLE) END AS carpet_area,
  CASE WHEN l_linenumber >= 6 THEN CAST(sqft AS DOUBLE) END AS plot_area
FROM x
""")
def parse_areas(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("areawithtype", _area_text())
    return li.select("l_orderkey", "l_linenumber", *[c.alias(n) for n, c in P.areas("areawithtype").items()])


def _age_text():
    k = F.col("o_orderkey") % 8
    y = F.year("o_orderdate").cast("string")
    return (F.when(k == 0, F.lit("0 to 1 Year Old")).when(k == 1, F.lit("1 to 5 Year Old"))
             .when(k == 2, F.lit("5 to 10 Year Old")).when(k == 3, F.lit("10+ Year Old"))
             .when(k == 4, F.concat(F.lit("By Dec "), y)).when(k == 5, F.concat(F.lit("Dec "), y))
             .when(k == 6, F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("Within 3 months"))
                   .otherwise(F.lit("Resale"))))


@query("parse_age", ops="B13", sql="""
SELECT CASE o_orderkey % 8 WHEN 0 THEN 'New Property' WHEN 1 THEN 'Relatively New' WHEN 2 THEN 'Moderately Old'
         WHEN 3 THEN 'Old Property' WHEN 4 THEN 'Under Construction' WHEN 5 THEN 'Under Construction'
         WHEN 6 THEN CASE WHEN o_orderpriority = '1-URGENT' THEN 'New Property' ELSE 'Undefined' END
         ELSE 'Undefined' END AS age_possession, count(*) AS n
FROM orders GROUP BY 1
""")
def parse_age(spark, sf):
    o = table(spark, sf, "orders").withColumn("property_age", _age_text())
    return o.groupBy(P.age_band("property_age").alias("age_possession")).agg(F.count(F.lit(1)).alias("n"))


@query("room_flags", ops="B12 B6", sql="""
WITH x AS (SELECT l_returnflag, l_returnflag = 'R' AS st, l_linestatus = 'O' AS sv, l_discount > 0.05 AS pj,
                  l_tax < 0.02 AS ot FROM lineitem)
SELECT l_returnflag, count(*) AS n,
  CAST(sum(st::INT) AS BIGINT) AS study_room, CAST(sum(sv::INT) AS BIGINT) AS servant_room,
  CAST(0 AS BIGINT) AS store_room, CAST(sum(pj::INT) AS BIGINT) AS pooja_room, CAST(sum(ot::INT) AS BIGINT) AS others,
  count(*) FILTER (WHERE NOT (st OR sv OR pj OR ot)) AS n_not_available
FROM x GROUP BY l_returnflag
""")
def room_flags(spark, sf):
    li = table(spark, sf, "lineitem")
    txt = F.concat_ws(",", F.when(F.col("l_returnflag") == "R", F.lit("Study Room")),
                      F.when(F.col("l_linestatus") == "O", F.lit("Servant Room")),
                      F.when(F.col("l_discount") > 0.05, F.lit("Pooja Room")),
                      F.when(F.col("l_tax") < 0.02, F.lit("Others")))
    li = li.withColumn("additional_room", F.nullif(txt, F.lit("")))
    flags = P.room_flags("additional_room")
    x = li.select("l_returnflag", *[c.alias(n) for n, c in flags.items()],
                  P.fill_lower("additional_room").alias("room_text"))
    return x.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(n).cast("long").alias(n) for n in flags],
        F.sum((F.col("room_text") == "not available").cast("long")).alias("n_not_available"))


ITEMS = ["Fan", "Exhaust Fan", "Fridge", "Light", "AC", "Bed"]


def _furnish_text():
    s = F.col("p_size")
    fridge = F.when(F.col("p_retailprice") > 950, F.lit("1 Fridge")).otherwise(F.lit("No Fridge"))
    txt = F.concat(F.lit("['"), (s % 5).cast("string"), F.lit(" Exhaust Fan', '"), (s % 7).cast("string"),
                   F.lit(" Fan', '"), fridge, F.lit("', 'Light', '"), (s % 3 + 1).cast("string"), F.lit(" AC']"))
    return F.when(s % 10 == 0, F.lit("[]")).otherwise(txt)


@query("item_counts", ops="B14 B15", sql="""
WITH x AS (SELECT p_type, p_size % 10 = 0 AS empty, p_size % 5 AS ex, p_retailprice > 950 AS fr, p_size % 3 + 1 AS ac
           FROM part)
SELECT p_type,
  CAST(sum(CASE WHEN empty THEN 0 ELSE ex END) AS BIGINT) AS "Fan",
  CAST(sum(CASE WHEN empty THEN 0 ELSE ex END) AS BIGINT) AS "Exhaust Fan",
  CAST(sum(CASE WHEN empty OR NOT fr THEN 0 ELSE 1 END) AS BIGINT) AS "Fridge",
  CAST(sum(CASE WHEN empty THEN 0 ELSE 1 END) AS BIGINT) AS "Light",
  CAST(sum(CASE WHEN empty THEN 0 ELSE ac END) AS BIGINT) AS "AC",
  CAST(0 AS BIGINT) AS "Bed",
  count(*) FILTER (WHERE empty) AS n_no_info
FROM x GROUP BY p_type
""")
def item_counts(spark, sf):
    p = table(spark, sf, "part").withColumn("details", P.clean_list_text(_furnish_text()))
    counts = P.item_counts("details", ITEMS)
    return p.groupBy("p_type").agg(*[F.sum(c).cast("long").alias(n) for n, c in counts.items()],
                                   F.sum((F.col("details") == "No Info").cast("long")).alias("n_no_info"))


@query("locality_standardize", ops="B8 B9 B20 D5", sql=W + """
, x AS (SELECT CASE nation_key % 3
          WHEN 0 THEN 'sector ' || CAST(nation_key AS VARCHAR)
          WHEN 1 THEN CASE WHEN nation_key % 2 = 0 THEN 'sector ' || CAST(nation_key + 100 AS VARCHAR)
                           ELSE lower(sector) END
          END AS locality FROM L)
SELECT locality, count(*) AS n,
       coalesce(TRY_CAST(regexp_extract(locality, '\\d+') AS DOUBLE), 'inf'::DOUBLE) AS locality_number
FROM x GROUP BY locality
""")
def locality_standardize(spark, sf):
    L = listing_view(spark, sf)
    k = F.col("nation_key")
    title = (F.when(k % 3 == 0, F.concat(F.lit("3 BHK Flat in "), F.replace("sector", F.lit("NATION_"), F.lit("Sector ")),
                                         F.lit(", Gurgaon")))
              .when(k % 3 == 1, F.concat(F.lit("Independent House in "), F.col("sector"), F.lit("-Gurgaon")))
              .otherwise(F.lit("Plot")))
    x = L.select(P.locality(title).alias("locality"))
    n = table(spark, sf, "nation")
    mapping = n.where(F.col("n_nationkey") % 2 == 0).select(
        F.lower("n_name").alias("raw"), F.concat(F.lit("sector "), (F.col("n_nationkey") + 100).cast("string")).alias("standard"))
    s = P.standardize(x, "locality", mapping)
    return s.groupBy("locality").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "locality_number", P.locality_number("locality"))


@query("map_explode", ops="A4 J5", sql="""
SELECT event_type, j.key AS key, CAST(sum(CAST(j.value AS INTEGER)) AS BIGINT) AS total, count(*) AS n
FROM events, json_each(props) j GROUP BY ALL
""")
def map_explode(spark, sf):
    e = table(spark, sf, "events").withColumn("m", P.decode_literal("props", "map<string,int>"))
    x = e.select("event_type", F.explode("m").alias("key", "value"))
    return x.groupBy("event_type", "key").agg(F.sum("value").cast("long").alias("total"), F.count(F.lit(1)).alias("n"))


@query("literal_fields", ops="A4", sql=r"""
SELECT o_orderkey, o_orderkey % 7 = 3 AS bad, o_orderkey % 7 <> 3 AND o_orderstatus = 'F' AS done,
       CASE WHEN o_orderkey % 7 <> 3 AND o_custkey % 3 > 0 THEN o_custkey ELSE -1 END AS customer,
       CASE WHEN o_orderkey % 7 <> 3 THEN round(o_totalprice, 2) END AS price,
       CASE WHEN o_orderkey % 7 <> 3 THEN o_orderpriority || chr(39) || 's "' || o_orderstatus || chr(10) || '\' END AS note,
       CASE WHEN o_orderkey % 7 <> 3 THEN o_orderkey % 7 ELSE 0 END AS n_tags
FROM orders
""")
def literal_fields(spark, sf):
    """Orders written as Python literals (None, True, tuples, both quotes, escapes, strings side by side, trailing
    commas; each seventh one is cut off) and read back."""
    from acreage.functions.literal import is_bad_literal
    o = table(spark, sf, "orders")
    tags = F.concat(F.lit("("), F.repeat(F.lit("'x', "), (F.col("o_orderkey") % 7).cast("int")), F.lit(")"))
    text = F.concat(
        F.lit("{'done': "), F.when(F.col("o_orderstatus") == "F", "True").otherwise("False"),
        F.lit(", u'customer': "), F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey").cast("string")).otherwise("None"),
        F.lit(', "price": +'), F.round("o_totalprice", 2).cast("decimal(18,2)").cast("string"),
        F.lit(", 'note': '"), F.col("o_orderpriority"), F.lit(r"""\'s "' """), F.lit('"'), F.col("o_orderstatus"), F.lit(r"""\n\\", 'tags': """), tags,
        F.when(F.col("o_orderkey") % 7 == 3, "").otherwise(",}"))
    kind = "struct<done: boolean, customer: bigint, price: double, note: string, tags: array<string>>"
    d = o.select("o_orderkey", text.alias("text")).select("o_orderkey", is_bad_literal("text").alias("bad"), P.decode_literal("text", kind, empty=False).alias("d"))
    ok = ~F.col("bad")
    return d.select("o_orderkey", "bad", (ok & F.coalesce("d.done", F.lit(False))).alias("done"), F.coalesce(F.when(ok, F.col("d.customer")), F.lit(-1).cast("long")).alias("customer"),
                    F.when(ok, F.round("d.price", 2)).alias("price"), F.when(ok, F.col("d.note")).alias("note"),
                    F.when(ok, F.size("d.tags").cast("long")).otherwise(F.lit(0).cast("long")).alias("n_tags"))


PRICE_DETAILS_SCHEMA = P.PRICE_DETAILS_SCHEMA


def _price_details_text():
    s, r = F.col("p_size"), F.col("p_retailprice")
    b1 = (s % 4 + 1).cast("string")
    b2 = (s % 4 + 2).cast("string")
    bt = F.when(F.col("p_type") == "LARGE", F.lit("Villa")).otherwise(F.lit("Apartment"))
    p1 = (F.floor(r) - 850).cast("string")
    dec = lambda x: F.concat((x / 10).cast("long").cast("string"), F.lit("."), (x % 10).cast("string"))
    e1 = F.concat(F.lit("'"), b1, F.lit(" BHK': {'building_type': '"), bt, F.lit("', 'area': '"),
                  F.format_number(s * 40, 0), F.lit(" sqft', 'price-range': '₹ "), p1, F.lit(" L - "), dec(s),
                  F.lit(" Cr'}"))
    rng2 = F.when(s % 10 == 0, F.lit("Price on Request")).otherwise(
        F.concat(F.lit("₹ "), dec(s), F.lit(" - "), dec(s + 10), F.lit(" Cr")))
    e2 = F.concat(F.lit("'"), b2, F.lit(" BHK': {'building_type': 'Villa', 'area': '"), F.format_number(s * 50, 0),
                  F.lit(" - "), F.format_number(s * 60, 0), F.lit(" sqft', 'price-range': '"), rng2, F.lit("'}"))
    return F.concat(F.lit("{"), e1, F.lit(", "), e2, F.lit("}"))


@query("price_profile", ops="B16", sql="""
WITH x AS (SELECT p_partkey, p_size AS s, floor(p_retailprice) - 850 AS p1, p_type FROM part)
, y AS (SELECT p_partkey, s, p_type, p1 / 100.0 AS a, (s // 10 + (s % 10) / 10.0) / 100.0 AS b,
               CASE WHEN s % 10 = 0 THEN NULL ELSE s // 10 + (s % 10) / 10.0 END AS c,
               CASE WHEN s % 10 = 0 THEN NULL ELSE (s + 10) // 10 + ((s + 10) % 10) / 10.0 END AS d FROM x)
SELECT p_partkey,
  round(CASE WHEN c IS NULL THEN least(a, b) ELSE least(a, b, c, d) END, 6) AS min_price_cr,
  round(CASE WHEN c IS NULL THEN greatest(a, b) ELSE greatest(a, b, c, d) END, 6) AS max_price_cr,
  round(CASE WHEN c IS NULL THEN (a + b) / 2 ELSE (((a + b) + c) + d) / 4 END, 6) AS avg_price_cr,
  CAST(least(s * 40, s * 50, s * 60) AS DOUBLE) AS min_area_sqft, CAST(greatest(s * 40, s * 50, s * 60) AS DOUBLE) AS max_area_sqft,
  round(((s * 40.0 + s * 50.0) + s * 60.0) / 3, 6) AS avg_area_sqft,
  s % 4 + 1 AS min_bhk, s % 4 + 2 AS max_bhk,
  CASE WHEN p_type = 'LARGE' THEN 'Villa' ELSE 'Apartment' END AS property_type
FROM y
""")
def price_profile(spark, sf):
    part = table(spark, sf, "part")
    p = spread(part, min_partitions=4 * spark.sparkContext.defaultParallelism).withColumn(
        "details", P.decode_literal(_price_details_text(), PRICE_DETAILS_SCHEMA, empty=False))
    cols = P.price_profile("details")
    return round_doubles(p.select("p_partkey", *[c.alias(n) for n, c in cols.items()]))


def _location_text():
    """LocationAdvantages text per supplier: duplicated landmark spellings,
    metres, kilometres and an unparsable distance."""
    a = F.col("s_acctbal")
    km = F.concat((F.abs(F.floor(a)) % 30 + 1).cast("string"), F.lit(".5 Km"))
    m = F.concat((F.abs(F.floor(a)) % 900 + 100).cast("string"), F.lit(" Meter"))
    return F.concat(F.lit("{'Intl Airport': '"), km, F.lit("', 'International Airport': '"), m,
                    F.lit("', 'NH8 Rd': 'nearby', '"), F.col("r_name"), F.lit(" Mall': '"), km, F.lit("'}"))


@query("landmark_table", ops="B17 B18 J5 J6", sql="""
WITH s AS (SELECT s_suppkey, r_name, (abs(floor(s_acctbal)) % 30 + 1) * 1000 + 500 AS km,
                  abs(floor(s_acctbal)) % 900 + 100 AS m
           FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT s_suppkey, 'international airport' AS landmark, CAST(least(km, m) AS DOUBLE) AS dist_m FROM s
UNION ALL SELECT s_suppkey, lower(r_name) || ' mall', CAST(km AS DOUBLE) FROM s
""")
def landmark_table(spark, sf):
    s = table(spark, sf, "supplier")
    n = table(spark, sf, "nation")
    r = table(spark, sf, "region")
    x = (s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
          .select("s_suppkey", P.decode_literal(_location_text(), "map<string,string>").alias("loc")))
    from acreage.operators.similarity import landmark_long
    return landmark_long(x, "s_suppkey", "loc").withColumnRenamed("landmark_key", "landmark")
