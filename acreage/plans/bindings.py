"""Bindings of the listing-shaped operators to the driver tables.

No driver table is a property listing, so operators (which take column names)
run on stand-ins derived from the given tables by fixed rules.  The listing
view ``L`` is lineitem joined to part, supplier and nation:

    property_type <- p_type      sector  <- n_name     society <- p_name
    price         <- l_extendedprice      area    <- l_quantity
    rate          <- price / area         bedrooms <- l_linenumber

Every derived table is computed by Spark from the given tables, so its size
grows with them.  Joins carry no broadcast hints: AQE picks broadcast vs
sort-merge from the measured sizes at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def listing_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    p = table(spark, sf_dir, "part")
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")
    j = (li.join(p, li.l_partkey == p.p_partkey)
           .join(s, li.l_suppkey == s.s_suppkey)
           .join(n, s.s_nationkey == n.n_nationkey))
    return j.select(
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("part_key"),
        F.col("l_suppkey").alias("supp_key"),
        F.col("p_type").alias("property_type"),
        F.col("n_name").alias("sector"),
        F.col("p_name").alias("society"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("area"),
        F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")).alias("rate"),
        F.col("l_linenumber").alias("bedrooms"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.col("l_returnflag").alias("returnflag"),
        F.col("l_linestatus").alias("linestatus"),
        F.col("p_brand").alias("brand"),
        F.col("p_size").alias("size"),
        F.col("p_retailprice").alias("retailprice"),
        F.col("s_acctbal").alias("supp_acctbal"),
        F.col("n_nationkey").alias("nation_key"),
    )


# The same view for the DuckDB oracle (the driver pre-registers the tables).
L_SQL = """
L AS (
  SELECT l.l_orderkey AS order_key, l.l_linenumber AS line_no, l.l_partkey AS part_key,
         l.l_suppkey AS supp_key, p.p_type AS property_type, n.n_name AS sector,
         p.p_name AS society, l.l_extendedprice AS price, l.l_quantity AS area,
         l.l_extendedprice / l.l_quantity AS rate, l.l_linenumber AS bedrooms,
         l.l_discount AS discount, l.l_tax AS tax, l.l_returnflag AS returnflag,
         l.l_linestatus AS linestatus, p.p_brand AS brand, p.p_size AS size,
         p.p_retailprice AS retailprice, s.s_acctbal AS supp_acctbal, n.n_nationkey AS nation_key
  FROM lineitem l
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey
)"""


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (comparison rule: round after aggregating)."""
    cols = []
    for name, dt in df.dtypes:
        if dt in ("double", "float"):
            cols.append(F.round(F.col(name).cast("double"), digits).alias(name))
        else:
            cols.append(F.col(name))
    return df.select(*cols)
