"""Market views (the tables behind the dashboard, inventory 2.E / 2.C / 2.D).

Each view takes column names, so it runs on any listing-shaped table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acreage.operators.ordered import quantiles
from acreage.operators.stats import cut_label


def filter_or_all(df: DataFrame, c: str, value) -> DataFrame:
    """The value "All" (or None) disables the filter."""
    if value is None or value == "All":
        return df
    return df.where(F.col(c) == F.lit(value))


def supply(df: DataFrame, key: str) -> DataFrame:
    """Listings per key, most first."""
    return (df.groupBy(key).agg(F.count(F.lit(1)).alias("n_listings"))
              .orderBy(F.col("n_listings").desc(), F.col(key).asc_nulls_last()))


def mix(df: DataFrame, group: str, kind: str) -> DataFrame:
    """Count per (group, kind), group total, share % (round 1).

    The group total is a window sum over the already-aggregated counts (at
    most |group| x |kind| rows), not a join back to the raw table."""
    g = df.groupBy(group, kind).agg(F.count(F.lit(1)).alias("listing_count"))
    tot = F.sum("listing_count").over(Window.partitionBy(group))
    return (g.withColumn("total_listings", tot)
             .withColumn("pct_of_sector", F.round(F.col("listing_count") / F.col("total_listings") * 100, 1)))


def dispersion(df: DataFrame, group: str, value: str, min_n: int = 15) -> DataFrame:
    """p25, p75, IQR and count per group; groups with fewer than
    ``min_n`` non-null values are dropped; widest IQR first."""
    q = quantiles(df, value, [0.25, 0.75], group, names=["p25", "p75"], count_as="listings")
    return (q.where(F.col("listings") >= min_n)
             .withColumn("iqr", F.col("p75") - F.col("p25"))
             .orderBy(F.col("iqr").desc(), F.col(group)))


def config_matrix(df: DataFrame, kind: str, rooms: str, lo: int = 1, hi: int = 6) -> DataFrame:
    """Share (%) of each room count within a kind, rooms in [lo, hi],
    pivoted to one column per room count (values passed, so no extra job)."""
    d = df.where(F.col(rooms).between(lo, hi))
    g = d.groupBy(kind, rooms).agg(F.count(F.lit(1)).alias("__n"))
    pct = F.round(F.col("__n") / F.sum("__n").over(Window.partitionBy(kind)) * 100, 1)
    g = g.withColumn("__pct", pct)
    values = list(range(lo, hi + 1))
    p = g.groupBy(kind).pivot(rooms, values).agg(F.first("__pct"))
    return p.fillna(0.0, [str(v) for v in values])


# Edges and labels of the area segments.
AREA_EDGES = [0, 1000, 2200, 3500, float("inf")]
AREA_LABELS = ["Small (<1000)", "Mid (1000–2200)", "Large (2200–3500)", "Luxury (3500+)"]


def area_segments(df: DataFrame, area: str, edges: Sequence[float] = AREA_EDGES,
                  labels: Sequence[str] = AREA_LABELS, out: str = "area_segment") -> DataFrame:
    """Right-closed area segments; rows outside every bin get null."""
    return df.withColumn(out, cut_label(area, edges, labels))


def parse_coordinates(df: DataFrame, c: str, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """A10: "28.36° N, 76.94° E" -> two doubles (bad text -> null)."""
    return (df.withColumn(lat, F.expr(f"try_cast(trim(split(get(split({c}, ','), 0), '°')[0]) as double)"))
              .withColumn(lon, F.expr(f"try_cast(trim(split(get(split({c}, ','), 1), '°')[0]) as double)")))


def geo_join(listings: DataFrame, coords: DataFrame, key: str, trim_keys: bool = True) -> DataFrame:
    """Attach coordinates by sector (inner).  ``trim_keys`` trims both keys so
    a dictionary entry with a trailing blank still matches.  The coordinate
    dictionary is tiny, but we let AQE choose the join from measured sizes."""
    ck = F.trim(F.col(key)) if trim_keys else F.col(key)
    c2 = coords.withColumn("__gk", ck).drop(key)
    l2 = listings.withColumn("__gk", ck)
    return l2.join(c2, "__gk", "inner").drop("__gk")


def geo_mean(df: DataFrame, key: str, cols: Sequence[str], kind: str | None = None,
             kind_value=None) -> DataFrame:
    """Per-sector mean of the given numeric columns, optional kind filter."""
    d = filter_or_all(df, kind, kind_value) if kind else df
    return d.groupBy(key).agg(*[F.avg(c).alias(c) for c in cols])


def amenities(df: DataFrame, arr: str, by: str | None = None, by_value=None) -> DataFrame:
    """Flatten amenity lists (optionally of one sector) and count them."""
    d = filter_or_all(df, by, by_value) if by else df
    x = d.select(F.explode(F.col(arr)).alias("amenity")).where(F.col("amenity").isNotNull())
    return x.groupBy("amenity").agg(F.count(F.lit(1)).alias("n"))


def words(df: DataFrame, text: str, stop: DataFrame | Sequence[str] = ("s",),
          pattern: str = r"\p{L}+") -> DataFrame:
    """Word frequencies of the whole text column.  Words are maximal letter
    runs, lower-cased; the stop list is removed with an anti join (Spark broadcasts it
    where it is measured small)."""
    toks = df.select(
        F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(pattern), 0)).alias("word"))
    if not isinstance(stop, DataFrame):
        stop = df.sparkSession.createDataFrame([(s,) for s in stop], "word string")
    toks = toks.join(stop, "word", "left_anti")
    return toks.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def options(df: DataFrame, c: str, all_label: str = "All") -> DataFrame:
    """Distinct non-null values sorted, with "All" first (order column)."""
    d = df.where(F.col(c).isNotNull()).select(F.col(c).cast("string").alias("option")).distinct()
    allrow = df.sparkSession.createDataFrame([(all_label,)], "option string")
    return (allrow.withColumn("is_all", F.lit(0)).unionByName(d.withColumn("is_all", F.lit(1)))
              .orderBy("is_all", "option").drop("is_all"))


def share(df: DataFrame, c: str, top: int | None = 5, digits: int = 2) -> DataFrame:
    """Normalised value counts (share of non-null rows), rounded; top n."""
    g = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))
    # the total is a one-row aggregate (broadcast by construction), not a
    # global window that would pull every distinct value into one task
    from acreage.operators.scalars import attach_row
    g = (attach_row(g, g.agg(F.sum("n").alias("__tot")))
          .withColumn("share", F.round(F.col("n") / F.col("__tot"), digits)).drop("__tot"))
    g = g.orderBy(F.col("n").desc(), F.col(c))
    return g.limit(top) if top else g


def default_category(df: DataFrame, by: str, c: str, skip: str = "other",
                     fallback: str = "other") -> DataFrame:
    """most frequent value of c per group, skipping ``skip`` (any case);
    ties go to the alphabetically first value; groups with nothing else get
    ``fallback``.  One aggregate with a struct max — no per-group collection."""
    cnt = (df.where(F.col(c).isNotNull())
             .groupBy(by, c).agg(F.count(F.lit(1)).alias("__n")))
    keep = cnt.where(F.lower(F.col(c)) != F.lit(skip.lower()))
    best = keep.groupBy(by).agg(F.min(F.struct((-F.col("__n")).alias("k"), F.col(c).alias("v"))).alias("__b"))
    groups = cnt.select(by).distinct()
    return (groups.join(best, by, "left")
                  .select(by, F.coalesce(F.col("__b.v"), F.lit(fallback)).alias(f"default_{c}")))
