"""Registered queries: incremental batches, joins, set operations, HTML (2.A, 2.D, 2.H)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from acreage.sources import html as H
from acreage.sources import io
from acreage.plans.bindings import round_doubles, table
from acreage.plans.registry import query
from acreage.session import ensure_checkpoint_dir
from acreage.sources.csv_splits import read_csv_split


@query("upsert_latest", ops="A6 H7 H5", sql="""
WITH u AS (SELECT user_id, event_id, ts, event_type, value, 0 AS seq FROM events WHERE value < 100
           UNION ALL SELECT user_id, event_id, ts, event_type, value, 1 FROM events WHERE value >= 50)
SELECT user_id, event_id, event_type, round(value, 6) AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC, ts DESC, event_id DESC) AS rn FROM u)
WHERE rn = 1
""")
def upsert_latest(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type", "value")
    existing = e.where(F.col("value") < 100)
    batch = e.where(F.col("value") >= 50)
    u = io.upsert_latest(existing, batch, "user_id", order=["ts", "event_id"])
    return round_doubles(u.select("user_id", "event_id", "event_type", "value"))


@query("pending_links", ops="A7 D6", sql="""
SELECT o_orderkey, o_custkey FROM orders
WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')
""")
def pending_links(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    done = table(spark, sf, "lineitem").where(F.col("l_linestatus") == "F").select(
        F.col("l_orderkey").alias("o_orderkey"))
    return io.pending(o, done, "o_orderkey")


@query("two_layer_join", ops="D1", sql="""
SELECT o.o_orderkey, c.c_custkey AS o_custkey, c.c_name, c.c_mktsegment, round(o.o_totalprice, 6) AS o_totalprice
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
""")
def two_layer_join(spark, sf):
    basic = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    detail = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment",
                                                 F.lit(0.0).alias("o_totalprice"))
    return round_doubles(io.two_layer_join(basic, detail, "o_custkey").select(
        "o_orderkey", "o_custkey", "c_name", "c_mktsegment", "o_totalprice"))


@query("set_diffs", ops="D10 H9", sql="""
SELECT 'a_only' AS part, k FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'
                                 EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')
UNION ALL SELECT 'b_only', k FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O'
                                   EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
UNION ALL SELECT 'both', k FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'
                                 INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')
""")
def set_diffs(spark, sf):
    o = table(spark, sf, "orders")
    a = o.where(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("k"))
    b = o.where(F.col("o_orderstatus") == "O").select(F.col("o_custkey").alias("k"))
    parts = io.set_diffs(a, b)
    out = None
    for name, df in parts.items():
        d = df.select(F.lit(name).alias("part"), "k")
        out = d if out is None else out.unionByName(d)
    return out


@query("dedup_rows", ops="H8 H6", sql="""
SELECT lang, count(*) AS n FROM (SELECT DISTINCT text, lang, source FROM documents) GROUP BY lang
""")
def dedup_rows(spark, sf):
    d = table(spark, sf, "documents").select("text", "lang", "source").dropDuplicates()
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("url_keys", ops="A8 B24", sql="""
SELECT page_id, CASE WHEN contains(url, 'example.') THEN split_part(url, 'example.', 2) END AS key,
       CASE WHEN contains(url, '/en/') THEN split_part(url, '/en/', 2) END AS en_path
FROM pages
""")
def url_keys(spark, sf):
    p = io.lower_header(table(spark, sf, "pages").toDF("PAGE_ID", "URL", "HTML"))
    return p.select("page_id", io.key_from_url("url", "example.").alias("key"),
                    io.key_from_url("url", "/en/").alias("en_path"))


@query("html_fields", ops="A5", sql="""
SELECT page_id,
  nullif(regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1), '') AS host,
  nullif(regexp_extract(html, '<html[^>]*\\blang="([^"]*)"', 1), '') AS lang,
  nullif(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '') AS title,
  nullif(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '') AS h1,
  CAST(len(regexp_extract_all(html, '<a\\s[^>]*href=')) AS INTEGER) AS n_links,
  CAST(len(regexp_extract_all(html, '<p>')) AS INTEGER) AS n_paragraphs
FROM pages
""")
def html_fields(spark, sf):
    p = table(spark, sf, "pages")
    f = H.extract_fields(p.withColumn("host", H.url_host("url")))
    return f.select("page_id", "host", "lang", "title", "h1", "n_links", "n_paragraphs")


@query("sample_rows", ops="H10", sql="""
SELECT o_orderkey, o_totalprice FROM (
  SELECT o_orderkey, o_totalprice, count(*) OVER () AS n,
         row_number() OVER (ORDER BY ('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || ':42'), 1, 15))::BIGINT, o_orderkey) AS r FROM orders)
WHERE r <= ceil(n * 0.1)
""")
def sample_rows(spark, sf):
    return io.sample(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 0.1, 42, "o_orderkey")


@query("multiline_csv", ops="A1 A2", sql="""
WITH d AS (SELECT doc_id, source, source || ': "' || coalesce(text, '') || '"' || chr(10) || 'end, of ' || CAST(doc_id AS VARCHAR) AS body FROM documents)
SELECT doc_id, source, length(body) AS n_chars, md5(body) AS body_md5 FROM d
""")
def multiline_csv(spark, sf):
    """Whole documents, written as CSV with quoted line breaks and read back by the reader that splits files."""
    body = F.concat("source", F.lit(': "'), F.coalesce("text", F.lit("")), F.lit('"\nend, of '), F.col("doc_id").cast("string"))
    docs = table(spark, sf, "documents").select("doc_id", "source", body.alias("body"))
    path = f"{ensure_checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"
    docs.write.options(header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    rows = read_csv_split(spark, path, docs.schema)
    return rows.select("doc_id", "source", F.length("body").cast("long").alias("n_chars"), F.md5(F.encode("body", "utf-8")).alias("body_md5"))
