"""Scans, sinks and incremental-batch operators (inventory 2.A, 2.D, 2.H).

Readers take a declared schema (no inference at 100 TB), sinks write Parquet,
and the incremental operators are aggregates or joins — never a window over
a whole key, so one hot key cannot stall a task.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- layer schemas -----------------------------------------------------------

RAW_LISTING_COLUMNS = ["property_id", "property_name", "link", "society", "price", "area", "areawithtype",
                       "bedrooms", "bathrooms", "balcony", "additional_room", "floor_info", "facing",
                       "property_age", "nearby_location", "furnishing_details", "features"]

RAW_LISTING = T.StructType([T.StructField(c, T.StringType(), True) for c in RAW_LISTING_COLUMNS])

GEO_SECTOR = T.StructType([T.StructField("sector", T.StringType()), T.StructField("coordinates", T.StringType())])

COEFFICIENT = T.StructType([T.StructField("feature", T.StringType()), T.StructField("coef", T.DoubleType())])

PROJECT_COLUMNS = ["PropertyName", "PropertySubName", "NearbyLocations", "LocationAdvantages", "Link",
                   "PriceDetails", "TopFacilities"]
PROJECT = T.StructType([T.StructField(c, T.StringType(), True) for c in PROJECT_COLUMNS])


def read_csv(spark: SparkSession, path: str, schema: T.StructType, corrupt: bool = False) -> DataFrame:
    """A1: header CSV with a declared schema; quoted fields may span lines and
    contain commas.  A missing path raises (the reference returned None)."""
    local = path[len("file:"):] if path.startswith("file:") else (None if "://" in path else path)
    if local is not None and not os.path.exists(local):
        raise FileNotFoundError(path)
    sch = schema
    opts = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"', "mode": "PERMISSIVE"}
    if corrupt:
        sch = T.StructType(list(schema.fields) + [T.StructField("_corrupt_record", T.StringType())])
        opts["columnNameOfCorruptRecord"] = "_corrupt_record"
    return spark.read.schema(sch).options(**opts).csv(path)


def read_listings(spark: SparkSession, path: str, schema: T.StructType = RAW_LISTING) -> DataFrame:
    return read_csv(spark, path, schema)


def save(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> str:
    """A2/A3: Parquet sink (optionally partitioned, e.g. by property_type).
    Writing a stage is also how lineage is cut between stages."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def stage(df: DataFrame, root: str, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """A3: write a pipeline layer and continue from what was written."""
    p = save(df, f"{root.rstrip('/')}/{name}", partition_by)
    return df.sparkSession.read.parquet(p)


def upsert_latest(existing: DataFrame, batch: DataFrame, key: Sequence[str] | str,
                  order: Sequence[str] = ()) -> DataFrame:
    """Append a batch and keep the LAST row per key (batch rows win over
    existing rows; within a side, the larger ``order`` wins).  Implemented as a
    ``max_by`` aggregate (partial aggregation map-side), not a window, so a hot
    key never sits in one task."""
    keys = [key] if isinstance(key, str) else list(key)
    cols = [c for c in existing.columns]
    u = (existing.select(*cols).withColumn("__seq", F.lit(0))
                 .unionByName(batch.select(*cols).withColumn("__seq", F.lit(1))))
    rank = F.struct(F.col("__seq"), *[F.col(c) for c in order])
    payload = F.struct(*[F.col(c) for c in cols if c not in keys])
    g = u.groupBy(*keys).agg(F.max_by(payload, rank).alias("__row"))
    return g.select(*keys, "__row.*")


def pending(links: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Links not yet processed (left anti join)."""
    return links.join(done.select(key).distinct(), key, "left_anti")


def two_layer_join(basic: DataFrame, detail: DataFrame, key: str, drop_dupes: bool = True) -> DataFrame:
    """Basic (listing cards) inner-joined to details on the key; columns
    present on both sides are taken from the basic side (no ``_x``/``_y``)."""
    shared = [c for c in detail.columns if c in basic.columns and c != key]
    d = detail.drop(*shared) if drop_dupes else detail
    return basic.join(d, key, "inner")


def set_diffs(a: DataFrame, b: DataFrame) -> dict[str, DataFrame]:
    """A minus b, b minus a and a intersect b (set semantics)."""
    return {"a_only": a.subtract(b), "b_only": b.subtract(a), "both": a.intersect(b)}


def key_from_url(c: str, marker: str = "spid-"):
    """Text after the first ``marker`` (matched literally)."""
    return F.get(F.split(F.col(c), "\\Q" + marker + "\\E"), 1)


def lower_header(df: DataFrame) -> DataFrame:
    """B24."""
    return df.toDF(*[c.lower() for c in df.columns])


def sample(df: DataFrame, fraction: float, seed: int = 42, key: Sequence[str] | str | None = None) -> DataFrame:
    """Exactly ceil(n * fraction) rows, those of the smallest seeded hash of ``key`` (all columns when None), whatever
    the partitioning.  Ranks come from value buckets, so no task sorts all rows.  Of rows with one key any may be taken."""
    from acreage.operators.ordered import hash_order, row_ranks
    keys = [key] if isinstance(key, str) else list(key or df.columns)
    ranked = row_ranks(df.withColumn("__h", hash_order(keys, seed)), "__h", tie_break=keys, out="__rank")
    return ranked.where(F.col("__rank") <= F.ceil(F.col("_tot") * fraction - 1e-9)).select(*df.columns)
