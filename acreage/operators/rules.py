"""Filters and validation (inventory 2.C).

A rule is a named boolean Column that says which rows to KEEP.  ``apply``
filters lazily and can report, in one aggregate pass, how many rows each rule
removes — no per-rule re-scan of the table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acreage.functions.parse import area_per_bedroom
from acreage.operators.ordered import quantiles


def require(cols: Sequence[str]) -> Column:
    """All listed columns non-null."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull()
    return cond


def cap(c: str, limit: float) -> Column:
    """Keep c <= limit; null is removed (comparison is null -> dropped)."""
    return F.coalesce(F.col(c) <= F.lit(limit), F.lit(False))


def ratio_rule(area: str, bedrooms: str, min_ratio: float = 200, big_rooms: int = 7,
               big_min_ratio: float = 300) -> Column:
    """C4: area/bedrooms >= 200 and not (bedrooms >= 7 and ratio < 300);
    a null ratio is removed; bedrooms = 0 gives +inf and is kept."""
    r = area_per_bedroom(area, bedrooms)
    keep = (r >= min_ratio) & ~((F.col(bedrooms) >= big_rooms) & (r < big_min_ratio))
    return F.coalesce(keep, F.lit(False))


def not_text(c: str, text: str) -> Column:
    """Drop rows whose value is exactly ``text``; null-safe (null kept)."""
    return ~F.coalesce(F.col(c) == F.lit(text), F.lit(False))


def apply(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Keep rows passing every rule (lazy)."""
    cond = F.lit(True)
    for r in rules.values():
        cond = cond & F.coalesce(r, F.lit(False))
    return df.where(cond)


def report(df: DataFrame, rules: Mapping[str, Column], sequential: bool = True) -> DataFrame:
    """C11: one aggregate pass.  For each rule: rows it fails, rows it removes
    when applied in the given order (``sequential``), and rows only it removes.
    Returns (rule_order, rule, n_before, n_failed, n_removed, n_only, n_after)."""
    names = list(rules)
    flags = {n: ~F.coalesce(rules[n], F.lit(False)) for n in names}
    aggs = [F.count(F.lit(1)).alias("__n")]
    prior = F.lit(False)
    for i, n in enumerate(names):
        others = F.lit(False)
        for m in names:
            if m != n:
                others = others | flags[m]
        aggs += [F.sum(flags[n].cast("long")).alias(f"__f{i}"),
                 F.sum((flags[n] & ~prior).cast("long")).alias(f"__r{i}"),
                 F.sum((flags[n] & ~others).cast("long")).alias(f"__o{i}")]
        prior = prior | flags[n]
    row = df.agg(*aggs)
    structs = []
    for i, n in enumerate(names):
        removed_before = sum((F.col(f"__r{j}") for j in range(i)), F.lit(0))
        structs.append(F.struct(
            F.lit(i).alias("rule_order"), F.lit(n).alias("rule"),
            (F.col("__n") - removed_before).cast("long").alias("n_before"),
            F.coalesce(F.col(f"__f{i}"), F.lit(0)).cast("long").alias("n_failed"),
            F.coalesce(F.col(f"__r{i}"), F.lit(0)).cast("long").alias("n_removed"),
            F.coalesce(F.col(f"__o{i}"), F.lit(0)).cast("long").alias("n_only"),
            (F.col("__n") - removed_before - F.coalesce(F.col(f"__r{i}"), F.lit(0))).cast("long").alias("n_after")))
    return row.select(F.inline(F.array(*structs)))


def iqr_fences(df: DataFrame, c: str, k_lo: float = 1.5, k_hi: float = 1.5, by=None) -> DataFrame:
    """Exact Q1, Q3 and fences Q1 - k_lo*IQR, Q3 + k_hi*IQR (per group)."""
    q = quantiles(df, c, [0.25, 0.75], by, names=["q1", "q3"])
    iqr = F.col("q3") - F.col("q1")
    return q.withColumn("lower_fence", F.col("q1") - k_lo * iqr).withColumn("upper_fence", F.col("q3") + k_hi * iqr)


def iqr_flag(df: DataFrame, c: str, k_lo: float = 1.5, k_hi: float = 1.5, out: str = "is_outlier") -> DataFrame:
    """Attach the global fences (a one-row table, broadcast by construction)
    and flag rows outside them; nulls are not outliers."""
    f = iqr_fences(df, c, k_lo, k_hi).select("lower_fence", "upper_fence")
    from acreage.operators.scalars import attach_row
    j = attach_row(df, f)
    v = F.col(c)
    return j.withColumn(out, F.coalesce((v < F.col("lower_fence")) | (v > F.col("upper_fence")), F.lit(False)))


def iqr_filter(df: DataFrame, c: str, k_lo: float = 1.5, k_hi: float = 1.5) -> DataFrame:
    """Keep rows inside the fences (and null rows, as pandas boolean masks do not)."""
    flagged = iqr_flag(df, c, k_lo, k_hi, "__out")
    return flagged.where(~F.col("__out")).drop("__out", "lower_fence", "upper_fence")


# ---- C10 request validation --------------------------------------------------

def range_rule(c: str, lo=None, hi=None, lo_open: bool = False, hi_open: bool = False) -> Column:
    v = F.col(c)
    ok = v.isNotNull()
    if lo is not None:
        ok = ok & ((v > lo) if lo_open else (v >= lo))
    if hi is not None:
        ok = ok & ((v < hi) if hi_open else (v <= hi))
    return ok


def enum_rule(c: str, allowed: Sequence) -> Column:
    return F.col(c).isin(list(allowed))


def validate(df: DataFrame, spec: Mapping[str, Column], defaults: Mapping[str, object] | None = None,
             reasons: str = "invalid_reasons") -> DataFrame:
    """Fill defaults, then evaluate every rule in-row and collect the
    names of failed rules into ``reasons`` (array<string>); ``is_valid`` when
    none failed.  Split good / rejected with a filter on ``is_valid``."""
    d = df
    for c, v in (defaults or {}).items():
        d = d.withColumn(c, F.coalesce(F.col(c), F.lit(v)) if c in d.columns else F.lit(v))
    failed = [F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in spec.items()]
    d = d.withColumn(reasons, F.filter(F.array(*failed), lambda x: x.isNotNull()))
    return d.withColumn("is_valid", F.size(F.col(reasons)) == 0)


# Enumerations, ranges and defaults of a price request.
REQUEST_PROPERTY_TYPES = ["Flat", "Independent House", "Independent Builder Floor"]
REQUEST_FURNISHING = ["Furnished", "Semi-Furnished", "Unfurnished"]
REQUEST_AGE = ["New Property", "Relatively New", "Moderately Old", "Old Property", "Under Construction", "Undefined"]
REQUEST_LUXURY = ["Budget", "Semi-Luxury", "Luxury"]
REQUEST_DEFAULTS = {"balcony": "0", "servant_room": 0, "pooja_room": 0, "facing": "east", "furnishing_type": "Unfurnished",
                    "age_possession": "Relatively New", "luxury_category": "Budget"}


def request_spec() -> dict[str, Column]:
    """The price-request rules: area in (100, 15000], bedrooms and bathrooms in 1..10, servant and
    pooja flags 0/1, enumerated property type, furnishing, age and luxury tier."""
    return {
        "property_type": enum_rule("property_type", REQUEST_PROPERTY_TYPES),
        "total_area_sqft": range_rule("total_area_sqft", 100, 15000, lo_open=True),
        "bedrooms": range_rule("bedrooms", 1, 10),
        "bathrooms": range_rule("bathrooms", 1, 10),
        "servant_room": enum_rule("servant_room", [0, 1]),
        "pooja_room": enum_rule("pooja_room", [0, 1]),
        "furnishing_type": enum_rule("furnishing_type", REQUEST_FURNISHING),
        "age_possession": enum_rule("age_possession", REQUEST_AGE),
        "luxury_category": enum_rule("luxury_category", REQUEST_LUXURY),
    }
