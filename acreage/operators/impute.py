"""Imputation and conditioning (inventory 2.F) and quantile binning (K1).

Group statistics are computed as aggregates (partial + final, bounded per
group) and attached with equi-joins; a hot key is split by AQE's skew-join
handling, never gathered by a window over the raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acreage.operators.ordered import ns_join, quantiles


def _one_row(df: DataFrame, row: DataFrame) -> DataFrame:
    # ``row`` is a global aggregate: exactly one row, broadcast by construction.
    from acreage.operators.scalars import attach_row
    return attach_row(df, row)


def missing_flags(df: DataFrame, cols: Sequence[str], suffix: str = "_missing") -> DataFrame:
    """0/1 null flag per column."""
    return df.withColumns({f"{c}{suffix}": F.col(c).isNull().cast("int") for c in cols})


# The property types.
SUPER_KINDS = ("Flat", "Independent Builder Floor")
PLOT_KINDS = ("Independent House",)


def primary_area(kind: str, super_area: str, plot_area: str, super_kinds=SUPER_KINDS, plot_kinds=PLOT_KINDS) -> Column:
    """flats / builder floors -> super built-up area, houses -> plot area, others null."""
    k = F.col(kind)
    return (F.when(k.isin(list(super_kinds)), F.col(super_area))
             .when(k.isin(list(plot_kinds)), F.col(plot_area)))


def row_median(cols: Sequence[str]) -> Column:
    """median of the non-null values of the row (mean of the middle two)."""
    arr = F.array_sort(F.filter(F.array(*[F.col(c).cast("double") for c in cols]), lambda x: x.isNotNull()))
    n = F.size(arr)
    mid = F.floor(n / 2).cast("int")
    odd = F.get(arr, mid)
    even = (F.get(arr, mid - 1) + F.get(arr, mid)) / 2
    return F.when(n == 0, F.lit(None).cast("double")).when(n % 2 == 1, odd).otherwise(even)


def fallback_area(primary: str, cols: Sequence[str]) -> Column:
    """primary area, else the row median of the other area columns."""
    return F.coalesce(F.col(primary), row_median(cols))


def max_area(cols: Sequence[str]) -> Column:
    """F4 (older variant): zero-fill then the largest."""
    return F.greatest(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols])


def coerce_numeric(df: DataFrame, cols: Sequence[str], to: str = "double") -> DataFrame:
    """bad text -> null."""
    return df.withColumns({c: F.col(c).try_cast(to) for c in cols})


def median_fill(df: DataFrame, c: str, out: str | None = None) -> DataFrame:
    """fill nulls with the exact median (skew-safe quantile primitive)."""
    med = quantiles(df, c, [0.5], names=["__med"])
    return _one_row(df, med).withColumn(out or c, F.coalesce(F.col(c), F.col("__med"))).drop("__med")


def mean_fill(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """fill nulls with the column mean (one aggregate row)."""
    means = df.agg(*[F.avg(c).alias(f"__m_{c}") for c in cols])
    j = _one_row(df, means)
    return j.withColumns({c: F.coalesce(F.col(c), F.col(f"__m_{c}")) for c in cols}).drop(
        *[f"__m_{c}" for c in cols])


def group_mode(df: DataFrame, c: str, keys: Sequence[str], out: str = "__mode") -> DataFrame:
    """Most frequent non-null value of c per key group (rows with any null key
    are left out); ties -> smallest value.  Partial aggregation on (keys, c),
    then a struct-min aggregate: no per-group collection."""
    d = df.where(F.col(c).isNotNull())
    for k in keys:
        d = d.where(F.col(k).isNotNull())
    cnt = d.groupBy(*keys, c).agg(F.count(F.lit(1)).alias("__n"))
    best = cnt.groupBy(*keys).agg(F.min(F.struct((-F.col("__n")).alias("k"), F.col(c).alias("v"))).alias("__b"))
    return best.select(*keys, F.col("__b.v").alias(out))


def mode_fill(df: DataFrame, c: str, sentinel: str = "Undefined",
              key_sets: Sequence[Sequence[str]] = (("sector", "property_type"), ("sector",), ("property_type",))
              ) -> DataFrame:
    """F8: replace ``sentinel`` by the mode of its group, one pass per key set,
    each pass seeing the previous pass's result.  The sentinel competes for the
    mode; a null key matches nothing; ties go to the alphabetically first."""
    d = df
    for keys in key_sets:
        keys = list(keys)
        m = group_mode(d, c, keys)
        d = d.join(m, keys, "left")  # null keys do not match: row kept as is
        d = d.withColumn(c, F.when((F.col(c) == sentinel) & F.col("__mode").isNotNull(), F.col("__mode"))
                           .otherwise(F.col(c))).drop("__mode")
    return d.select(*df.columns)


def cap_rare(df: DataFrame, c: str, min_count: int = 5, other: str = "Other") -> DataFrame:
    """values seen fewer than ``min_count`` times -> ``other``; null stays null.
    Counts are an aggregate joined back on the value."""
    cnt = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("__cnt"))
    j = df.join(cnt, c, "left")
    return j.withColumn(c, F.when(F.col("__cnt") < min_count, F.lit(other)).otherwise(F.col(c))).select(*df.columns)


def floor_band(c) -> Column:
    """null -> Undefined; <=5 Low-rise; <=15 Mid-rise; else High-rise."""
    v = F.col(c).cast("double") if isinstance(c, str) else c.cast("double")
    return (F.when(v.isNull(), "Undefined").when(v <= 5, "Low-rise")
             .when(v <= 15, "Mid-rise").otherwise("High-rise"))


def qcut(df: DataFrame, c: str, q: int, labels: Sequence[str] | None = None, out: str = "bin",
         by=None) -> DataFrame:
    """K1 ``pd.qcut(c, q, labels, duplicates='drop')``: exact linear quantile
    edges, right-closed bins, lowest edge included, duplicate edges dropped.

    When edges collapse the surviving bins are numbered ("bin_0", ...) instead
    of raising.  ``out`` gets the label, ``out + '_code'`` the 0-based bin.
    Edges are one row per group (one row globally), computed by the skew-safe
    quantile primitive; the bin is found in-row by counting edges below v."""
    keys = [] if by is None else ([by] if isinstance(by, str) else list(by))
    probs = [i / q for i in range(q + 1)]
    names = [f"__e{i}" for i in range(q + 1)]
    e = quantiles(df, c, probs, keys, names=names)
    e = e.select(*keys, F.array_distinct(F.array(*[F.col(n) for n in names])).alias("__edges"))
    j = ns_join(df, e, keys, "left") if keys else _one_row(df, e)
    v = F.col(c).cast("double")
    edges = F.col("__edges")
    below = F.size(F.filter(edges, lambda x: x < v))
    inside = (v >= F.get(edges, 0)) & (v <= F.element_at(edges, -1))
    code = F.when(inside, F.greatest(below - 1, F.lit(0)))
    nb = F.size(edges) - 1
    if labels:
        lab_arr = F.array(*[F.lit(x) for x in labels])
        label = F.when(nb == len(labels), F.get(lab_arr, code)).otherwise(F.concat(F.lit("bin_"), code.cast("string")))
    else:
        label = code.cast("string")
    return j.withColumn(f"{out}_code", code).withColumn(out, F.when(code.isNotNull(), label)).drop("__edges")
