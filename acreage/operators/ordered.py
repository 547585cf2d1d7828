"""Distributed ordered primitives: running totals, exact quantiles and row ranks.

Why not ``percentile`` / ``row_number().over(partitionBy(g))`` directly?  Both put
every distinct value of a group into one task.  When one group holds a third of
a 100 TB table that task never finishes.  Here every ordered computation is split
into *value buckets*:

1. a mergeable quantile sketch (``percentile_approx``, bounded memory) picks
   order-preserving bucket splitters over the values: as many buckets as the
   session has shuffle partitions, so the user's setting for the data also sizes
   the buckets;
2. per (group, bucket) totals are aggregated (at most groups x buckets rows) and
   turned into bucket offsets with a window over those few rows;
3. the exact work (running sums, rank selection) runs in windows partitioned by
   (group, bucket), so a hot group is spread over all buckets.

The plan is the same at every size.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _keys(by) -> list[str]:
    if by is None:
        return []
    if isinstance(by, str):
        return [by]
    return list(by)


def ns_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL matches NULL (group keys may be null)."""
    keys = list(keys)
    if not keys:
        raise ValueError("ns_join needs at least one key")
    ren = {k: f"__r_{k}" for k in keys}
    r = right.withColumnsRenamed(ren)
    cond = [left[k].eqNullSafe(r[ren[k]]) for k in keys]
    return left.join(r, cond, how).drop(*ren.values())


def bucket_number(df: DataFrame) -> int:
    """Buckets of an ordered computation: the session's shuffle partitions."""
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def plan_splitters(df: DataFrame, value: str, buckets: int | None = None) -> list[float]:
    """Sorted distinct interior splitters that deal the values of ``df`` into about
    equal buckets.  One action sketches the distribution; accuracy 20x the bucket
    count keeps bucket sizes within a few percent of each other."""
    want = buckets or bucket_number(df)
    probs = [i / want for i in range(1, want)]
    row = df.agg(F.percentile_approx(F.col(value).cast("double"), probs, max(1000, 20 * want)).alias("s")).first()
    return sorted({x for x in (row["s"] or []) if x is not None and not math.isnan(x)})


def with_bucket(df: DataFrame, value: str, splitters: Sequence[float], out: str = "_b") -> DataFrame:
    if not splitters:      # no value, or a single one
        # a column expression (not a literal) so joins on the
        # bucket id stay equi-joins instead of being folded into cross joins
        return df.withColumn(out, F.when(F.col(value).isNull(), F.lit(-1.0)).otherwise(F.lit(0.0)))
    tmp = "__bucket_in"
    bz = Bucketizer(splits=[-math.inf, *splitters, math.inf], inputCol=tmp, outputCol=out,
                    handleInvalid="keep")
    return bz.transform(df.withColumn(tmp, F.col(value).cast("double"))).drop(tmp)


def running_total(df: DataFrame, value: str, by=None, weight: str | None = None,
                  tie_break: Sequence[str] = (), out: str = "_cum", total: str = "_tot",
                  splitters: Sequence[float] | None = None) -> DataFrame:
    """Add ``out`` = inclusive running sum of ``weight`` (1 per row when None) in
    ``value`` order within ``by``, and ``total`` = group total.  Null values
    must be filtered by the caller."""
    keys = _keys(by)
    if splitters is None:
        splitters = plan_splitters(df, value)
    w = F.col(weight) if weight else F.lit(1)
    wname = "__w"
    d = with_bucket(df.withColumn(wname, w), value, splitters)
    bt = d.groupBy(*keys, "_b").agg(F.sum(wname).alias("_bw"))
    order = Window.partitionBy(*keys).orderBy("_b")
    bt = (bt.withColumn("_off", F.coalesce(
            F.sum("_bw").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .withColumn(total, F.sum("_bw").over(Window.partitionBy(*keys)))
            .drop("_bw"))
    d = ns_join(d, bt, keys + ["_b"]) if keys else d.join(bt, "_b")
    inner = (Window.partitionBy(*keys, "_b").orderBy(F.col(value), *[F.col(c) for c in tie_break])
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (d.withColumn(out, F.col("_off") + F.sum(wname).over(inner))
             .drop("_off", "_b", wname))


def value_counts(df: DataFrame, value: str, by=None, weight: str | None = None,
                 out: str = "_w") -> DataFrame:
    """Distinct (group, value) with counts (or summed weights); nulls dropped.
    Partial aggregation happens map-side before the shuffle."""
    keys = _keys(by)
    agg = F.sum(weight) if weight else F.count(F.lit(1))
    return (df.where(F.col(value).isNotNull())
              .groupBy(*keys, value).agg(agg.alias(out)))


def _names(probs, names):
    if names:
        return list(names)
    return [f"q{str(p).replace('0.', '').replace('.', '_')}" for p in probs]


def quantiles(df: DataFrame, value: str, probs: Sequence[float], by=None,
              names: Sequence[str] | None = None, weight: str | None = None,
              count_as: str | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles (= Spark ``percentile``, pandas
    ``quantile``, DuckDB ``quantile_cont``) per group, skew-safe.

    ``weight`` gives each row a frequency (like ``percentile(v, p, freq)``).
    Returns one row per group: keys, one column per prob, optional count column.
    """
    keys = _keys(by)
    probs = list(probs)
    names = _names(probs, names)
    vc = value_counts(df, value, keys, weight)
    r = running_total(vc, value, keys, weight="_w")
    hits = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("_tot") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        start = F.col("_cum") - F.col("_w")
        r = r.withColumn(f"__lo{i}", (lo >= start) & (lo < F.col("_cum")))
        r = r.withColumn(f"__hi{i}", (hi >= start) & (hi < F.col("_cum")))
        hits += [F.col(f"__lo{i}"), F.col(f"__hi{i}")]
    any_hit = hits[0]
    for h in hits[1:]:
        any_hit = any_hit | h
    sel = r.where(any_hit)
    aggs = [F.max("_tot").alias("_tot")]
    for i in range(len(probs)):
        aggs.append(F.max(F.when(F.col(f"__lo{i}"), F.col(value))).alias(f"__xlo{i}"))
        aggs.append(F.max(F.when(F.col(f"__hi{i}"), F.col(value))).alias(f"__xhi{i}"))
    g = sel.groupBy(*keys).agg(*aggs)
    outs = [F.col(k) for k in keys]
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("_tot") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        xlo, xhi = F.col(f"__xlo{i}").cast("double"), F.col(f"__xhi{i}").cast("double")
        interp = F.when((hi == lo) | (xlo == xhi), xlo).otherwise((hi - pos) * xlo + (pos - lo) * xhi)
        outs.append(interp.alias(names[i]))
    if count_as:
        outs.append(F.col("_tot").cast("long").alias(count_as))
    return g.select(*outs)


def median_col_table(df: DataFrame, value: str, by=None, name: str = "median") -> DataFrame:
    return quantiles(df, value, [0.5], by, names=[name])


def row_ranks(df: DataFrame, order_value: str, by=None, tie_break: Sequence[str] = (),
              out: str = "_rank") -> DataFrame:
    """1-based rank of each row in ``order_value`` order within ``by``; ties are
    broken by ``tie_break``.  Adds ``_tot`` (group size).  Skew-safe."""
    return running_total(df.where(F.col(order_value).isNotNull()), order_value, by,
                         tie_break=tie_break, out=out)


def hash_order(key_cols: Sequence[str], seed: int | Column = 42) -> Column:
    """Reproducible pseudo-random order key: first 15 hex digits of
    md5(concat_ws(':', keys..., seed)) as a bigint (same value in DuckDB)."""
    txt = F.concat_ws(":", *[F.col(c).cast("string") for c in key_cols], seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed)))
    return F.conv(F.substring(F.md5(txt), 1, 15), 16, 10).cast("long")
