"""Pricing insight from log-price regression coefficients (inventory 2.L).

Inputs are small tables (coefficients, scenario grid), but every operator is a
column expression or a join, so a scenario table of any size is fine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _one_row(df: DataFrame, row: DataFrame) -> DataFrame:
    from acreage.operators.scalars import attach_row
    return attach_row(df, row)


def feature_stds(df: DataFrame, cols) -> DataFrame:
    """Sample standard deviations (ddof 1), long (feature, std)."""
    row = df.agg(*[F.stddev_samp(c).alias(c) for c in cols])
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("std")) for c in cols])))


def base_price(df: DataFrame, price_cr: str, scale: float = 1e7) -> DataFrame:
    """Median price (exact) times ``scale`` (crore -> rupees): one row."""
    from acreage.operators.ordered import quantiles
    return quantiles(df, price_cr, [0.5], names=["__m"]).select((F.col("__m") * scale).alias("base_price_rs"))


def impact(scenarios: DataFrame, coefs: DataFrame, stds: DataFrame, base: DataFrame) -> DataFrame:
    """L1/L2: for each (scenario, feature, delta): scaled = delta / std,
    log change = coef * scaled, pct = (e^x - 1) * 100, abs = base * (e^x - 1),
    lakh = abs / 1e5."""
    j = scenarios.join(coefs, "feature").join(stds, "feature")
    j = _one_row(j, base)
    lc = F.col("coef") * (F.col("delta") / F.col("std"))
    return j.select("scenario", "feature", "delta", lc.alias("log_change"),
                    ((F.exp(lc) - 1) * 100).alias("pct_change"),
                    (F.col("base_price_rs") * (F.exp(lc) - 1)).alias("abs_change"),
                    (F.col("base_price_rs") * (F.exp(lc) - 1) / 1e5).alias("lakh_change"))


def combine(impacts: DataFrame, base: DataFrame) -> DataFrame:
    """L3: per scenario, sum the log changes and exponentiate once."""
    g = impacts.groupBy("scenario").agg(F.sum("log_change").alias("log_change"))
    g = _one_row(g, base)
    m = F.exp(F.col("log_change"))
    return g.select("scenario", "log_change", ((m - 1) * 100).alias("pct_change"),
                    (F.col("base_price_rs") * (m - 1)).alias("abs_change"))


def group_premium(coefs: DataFrame, prefix: str, label: str = "label") -> DataFrame:
    """L4: coefficients whose name starts with ``prefix``; label = name without
    it; premium % = (e^(coef - mean coef of the group) - 1) * 100.  The dropped
    base level is not in the mean (it has no coefficient)."""
    d = coefs.where(F.col("feature").startswith(prefix)).select(
        F.expr(f"substring(feature, {len(prefix) + 1})").alias(label), "coef")
    d = _one_row(d, d.agg(F.avg("coef").alias("__avg")))
    d = d.withColumn("coef_vs_avg", F.col("coef") - F.col("__avg")).drop("__avg")
    return d.withColumn("premium_pct", (F.exp("coef_vs_avg") - 1) * 100)


def extremes_resorted(df: DataFrame, c: str, n: int = 10, largest: bool = True, tie: str | None = None) -> DataFrame:
    """N largest (or smallest), then re-sorted ascending for display."""
    o = F.col(c).desc() if largest else F.col(c).asc()
    extra = [F.col(tie)] if tie else []
    return df.orderBy(o, *extra).limit(n).orderBy(F.col(c).asc(), *extra)


def per_std_effect(coefs: DataFrame) -> DataFrame:
    """|e^coef - 1| * 100 with a direction word."""
    e = F.exp("coef") - 1
    return coefs.withColumn("effect_pct", F.abs(e) * 100).withColumn(
        "direction", F.when(e >= 0, F.lit("increase")).otherwise(F.lit("decrease")))


def group_effects(df: DataFrame, target: str, groups: dict[str, str]) -> DataFrame:
    """Coefficient-shaped table of per-level effects: mean of ``target`` in the
    level minus the overall mean, named "<prefix><level>".  Used to bind the
    insight operators to data that has no fitted regression."""
    overall = df.agg(F.avg(target).alias("__all"))
    parts = []
    for col, prefix in groups.items():
        g = df.groupBy(col).agg(F.avg(target).alias("__m"))
        g = _one_row(g, overall).select(F.concat(F.lit(prefix), F.col(col).cast("string")).alias("feature"),
                                        (F.col("__m") - F.col("__all")).alias("coef"))
        parts.append(g)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
