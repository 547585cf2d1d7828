"""Descriptive statistics as DataFrame operators (inventory 2.E).

Every function is lazy except where noted (a pivot without a value list, and
the quantile planners, run one small job).  Exact quantiles go through
:mod:`acreage.operators.ordered`, so a hot group is never held by one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acreage.operators.ordered import _keys, ns_join, quantiles, running_total, value_counts


def _join_on(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return ns_join(left, right, keys) if keys else _one_row_join(left, right)


def _one_row_join(left: DataFrame, right: DataFrame) -> DataFrame:
    # Both sides have exactly one row (global aggregates): join on a constant key.
    from acreage.operators.scalars import attach_row
    return attach_row(left, right)


def describe(df: DataFrame, c: str, by=None) -> DataFrame:
    """count, mean, std (ddof 1), min, 25/50/75 %, max — like pandas ``describe``."""
    keys = _keys(by)
    base = df.groupBy(*keys).agg(
        F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
        F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"))
    q = quantiles(df, c, [0.25, 0.5, 0.75], keys, names=["q25", "q50", "q75"])
    out = _join_on(base, q, keys)
    return out.select(*keys, "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def shape(df: DataFrame, c: str, by=None) -> DataFrame:
    """Bias-corrected skewness G1 and excess kurtosis G2 (pandas ``skew``/``kurt``).

    Spark's ``skewness``/``kurtosis`` are the population moments g1, g2;
    G1 = g1*sqrt(n(n-1))/(n-2), G2 = (n-1)/((n-2)(n-3))*((n+1)g2 + 6).
    """
    keys = _keys(by)
    n = F.count(c).cast("double")
    g = df.groupBy(*keys).agg(n.alias("n"), F.skewness(c).alias("g1"), F.kurtosis(c).alias("g2"))
    nn = F.col("n")
    skew = F.when(nn > 2, F.col("g1") * F.sqrt(nn * (nn - 1)) / (nn - 2))
    kurt = F.when(nn > 3, (nn - 1) / ((nn - 2) * (nn - 3)) * ((nn + 1) * F.col("g2") + 6))
    return g.select(*keys, nn.cast("long").alias("n"), skew.alias("skew"), kurt.alias("kurt"))


def quantile_table(df: DataFrame, c: str, probs: Sequence[float], by=None) -> DataFrame:
    """Long table (keys, p, value) of exact quantiles."""
    keys = _keys(by)
    names = [f"__p{i}" for i in range(len(probs))]
    wide = quantiles(df, c, probs, keys, names=names)
    pairs = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.col(nm).alias("value"))
                      for p, nm in zip(probs, names)])
    return wide.select(*keys, F.inline(pairs))


def cut_label(c: str, edges: Sequence[float], labels: Sequence[str] | None = None,
              right: bool = True):
    """``pd.cut``: right-closed (lo, hi] bins (left-closed with right=False);
    out-of-range and null -> null.  A ``when`` ladder, so it stays in codegen."""
    if labels is None:
        labels = [f"{edges[i]}-{edges[i + 1]}" for i in range(len(edges) - 1)]
    v = F.col(c)
    expr = None
    for i in range(len(edges) - 1):
        lo, hi = float(edges[i]), float(edges[i + 1])
        cond = (v > lo) & (v <= hi) if right else (v >= lo) & (v < hi)
        expr = F.when(cond, F.lit(labels[i])) if expr is None else expr.when(cond, F.lit(labels[i]))
    return expr


def cut_counts(df: DataFrame, c: str, edges: Sequence[float], labels: Sequence[str] | None = None,
               label_col: str = "bin") -> DataFrame:
    """Counts per ``pd.cut`` bin with every label present (zero counts kept),
    in label order, and percentage of the binned rows."""
    spark = df.sparkSession
    if labels is None:
        labels = [f"{edges[i]}-{edges[i + 1]}" for i in range(len(edges) - 1)]
    counted = (df.select(cut_label(c, edges, labels).alias(label_col))
                 .where(F.col(label_col).isNotNull())
                 .groupBy(label_col).agg(F.count(F.lit(1)).alias("count")))
    # The label list is a parameter of fixed, tiny size: safe to broadcast.
    lab = spark.createDataFrame([(i, lb) for i, lb in enumerate(labels)], f"bin_order int, {label_col} string")
    out = F.broadcast(lab).join(counted, label_col, "left").fillna(0, ["count"])
    tot = F.sum("count").over(Window.partitionBy())
    return out.select("bin_order", label_col, F.col("count").cast("long").alias("count"),
                      (F.col("count") / tot * 100).alias("percentage"))


def histogram(df: DataFrame, c: str, lo: float, hi: float, n_bins: int) -> DataFrame:
    """Equal-width histogram on [lo, hi]; the last bin is closed.  Density is
    count / (n * width) like numpy ``density=True``."""
    width = (hi - lo) / n_bins
    v = F.col(c)
    b = F.least(F.floor((v - F.lit(lo)) / F.lit(width)).cast("int"), F.lit(n_bins - 1))
    g = (df.where(v.isNotNull() & (v >= lo) & (v <= hi)).select(b.alias("bin"))
           .groupBy("bin").agg(F.count(F.lit(1)).alias("count")))
    spark = df.sparkSession
    bins = spark.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    out = F.broadcast(bins).join(g, "bin", "left").fillna(0, ["count"])
    n = F.sum("count").over(Window.partitionBy())
    return out.select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_lo"),
                      (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("bin_hi"),
                      F.col("count").cast("long").alias("count"),
                      (F.col("count") / (n * F.lit(width))).alias("density"))


def ecdf(df: DataFrame, c: str, by=None) -> DataFrame:
    """Cumulative share of rows with value <= v, divided by *all* rows of the
    group (nulls included), as the reference's value_counts().cumsum()/len().
    Distinct values are aggregated first; running sums are bucketed."""
    keys = _keys(by)
    vc = value_counts(df, c, keys)
    r = running_total(vc, c, keys, weight="_w")
    n_all = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n_all"))
    r = ns_join(r, n_all, keys) if keys else _one_row_join(r, n_all)
    return r.select(*keys, F.col(c).alias("value"), F.col("_w").cast("long").alias("count"),
                    F.col("_cum").cast("long").alias("cum_count"),
                    (F.col("_cum") / F.col("_n_all")).alias("ecdf"))


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pairwise Pearson correlations (pairwise-complete, like pandas) in one
    aggregate over the upper triangle, mirrored; returned long (col_a, col_b, corr).
    The diagonal is 1 when the column varies."""
    cols = list(cols)
    aggs, cells = [], []
    for i, a in enumerate(cols):
        aggs.append(F.when(F.stddev_samp(a) > 0, F.lit(1.0)).alias(f"__d{i}"))
        cells.append((a, a, f"__d{i}"))
        for j in range(i + 1, len(cols)):
            b = cols[j]
            nm = f"__c{i}_{j}"
            aggs.append(F.corr(a, b).alias(nm))
            cells += [(a, b, nm), (b, a, nm)]
    row = df.agg(*aggs)
    arr = F.array(*[F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(nm).alias("corr"))
                    for a, b, nm in cells])
    return row.select(F.inline(arr))


def crosstab(df: DataFrame, r: str, c: str, values: Sequence | None = None) -> DataFrame:
    """Counts of r x c pivoted on c; missing cells are 0.  Pass ``values`` to
    avoid the extra distinct job."""
    g = df.groupBy(r).pivot(c, list(values) if values is not None else None).agg(F.count(F.lit(1)))
    return g.fillna(0)


def pivot(df: DataFrame, r: str, c: str, v: str, agg: str = "mean",
          values: Sequence | None = None) -> DataFrame:
    """``pivot_table``: mean / median / sum / count of v for r x c."""
    if agg == "median":
        q = quantiles(df, v, [0.5], [r, c], names=["__m"])
        return q.groupBy(r).pivot(c, list(values) if values is not None else None).agg(F.first("__m"))
    fn = {"mean": F.avg, "sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[agg]
    return df.groupBy(r).pivot(c, list(values) if values is not None else None).agg(fn(v))


def missing(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Null count and percentage per column, most missing first (one pass)."""
    cols = list(cols or df.columns)
    aggs = [F.sum(F.col(c).isNull().cast("long")).alias(f"__n{i}") for i, c in enumerate(cols)]
    row = df.agg(F.count(F.lit(1)).alias("__rows"), *aggs)
    arr = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"__n{i}").alias("n_null"))
                    for i, c in enumerate(cols)])
    return row.select(F.col("__rows").alias("n_rows"), F.inline(arr)).select(
        "column", F.coalesce("n_null", F.lit(0)).cast("long").alias("n_null"),
        F.round(F.coalesce("n_null", F.lit(0)) / F.col("n_rows") * 100, 6).alias("null_pct"))


def duplicates(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows, distinct rows and duplicate rows over ``cols`` (all columns by default)."""
    d = df.select(*(cols or df.columns))
    n = d.agg(F.count(F.lit(1)).alias("n_rows"))
    nd = d.distinct().agg(F.count(F.lit(1)).alias("n_distinct"))
    return _one_row_join(n, nd).select(
        "n_rows", "n_distinct", (F.col("n_rows") - F.col("n_distinct")).alias("n_duplicates"))


def cardinality_bands(df: DataFrame, key: str, bands: Sequence[tuple]) -> DataFrame:
    """Count keys whose frequency falls in each band.  ``bands`` is a list of
    (label, lo, hi) with inclusive bounds (None = open); bands may overlap."""
    freq = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__f"))
    aggs = []
    for i, (label, lo, hi) in enumerate(bands):
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (F.col("__f") >= lo)
        if hi is not None:
            cond = cond & (F.col("__f") <= hi)
        aggs.append(F.sum(cond.cast("long")).alias(f"__b{i}"))
    row = freq.agg(*aggs)
    arr = F.array(*[F.struct(F.lit(i).alias("band_order"), F.lit(lb).alias("band"),
                             F.coalesce(F.col(f"__b{i}"), F.lit(0)).cast("long").alias("n_keys"))
                    for i, (lb, _, _) in enumerate(bands)])
    return row.select(F.inline(arr))


def box(df: DataFrame, c: str, by=None, k: float = 1.5) -> DataFrame:
    """Box-plot numbers per group: quartiles, IQR, fences, whiskers (most extreme
    values inside the fences), outlier count, min, max, n."""
    keys = _keys(by)
    q = quantiles(df, c, [0.25, 0.5, 0.75], keys, names=["q1", "median", "q3"], count_as="n")
    q = (q.withColumn("iqr", F.col("q3") - F.col("q1"))
          .withColumn("lower_fence", F.col("q1") - k * F.col("iqr"))
          .withColumn("upper_fence", F.col("q3") + k * F.col("iqr")))
    x = df.where(F.col(c).isNotNull()).select(*keys, F.col(c).cast("double").alias("__v"))
    j = ns_join(x, q.select(*keys, "lower_fence", "upper_fence"), keys) if keys else _one_row_join(
        x, q.select("lower_fence", "upper_fence"))
    inside = (F.col("__v") >= F.col("lower_fence")) & (F.col("__v") <= F.col("upper_fence"))
    w = j.groupBy(*keys).agg(
        F.min(F.when(inside, F.col("__v"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("__v"))).alias("whisker_hi"),
        F.sum((~inside).cast("long")).alias("n_outliers"),
        F.min("__v").alias("min"), F.max("__v").alias("max"))
    out = ns_join(q, w, keys) if keys else _one_row_join(q, w)
    return out.select(*keys, "n", "min", "q1", "median", "q3", "iqr", "lower_fence", "upper_fence",
                      "whisker_lo", "whisker_hi", "n_outliers", "max")


def group_stats(df: DataFrame, c: str, by, stats: Sequence[str] = ("mean", "median")) -> DataFrame:
    """Per-group mean / median / count / std of c."""
    keys = _keys(by)
    base_aggs = {"mean": F.avg(c), "count": F.count(c), "std": F.stddev_samp(c),
                 "min": F.min(c), "max": F.max(c), "sum": F.sum(c)}
    aggs = [base_aggs[s].alias(s) for s in stats if s in base_aggs]
    out = df.groupBy(*keys).agg(*aggs) if aggs else df.select(*keys).distinct()
    if "median" in stats:
        out = ns_join(out, quantiles(df, c, [0.5], keys, names=["median"]), keys)
    return out.select(*keys, *[s for s in stats])


def presence_rate(df: DataFrame, label: str, items: Sequence[str]) -> DataFrame:
    """Per label: % of rows with item > 0 and mean count, for each item (long)."""
    aggs = []
    for i, it in enumerate(items):
        aggs.append((F.avg((F.col(it) > 0).cast("double")) * 100).alias(f"__p{i}"))
        aggs.append(F.avg(F.col(it)).alias(f"__m{i}"))
    g = df.groupBy(label).agg(*aggs)
    arr = F.array(*[F.struct(F.lit(it).alias("item"), F.col(f"__p{i}").alias("presence_pct"),
                             F.col(f"__m{i}").alias("mean_count")) for i, it in enumerate(items)])
    return g.select(label, F.inline(arr))


def extremes(df: DataFrame, c: str, n: int, largest: bool = True, tie_break: Sequence[str] = ()):
    """n largest / smallest rows (TakeOrderedAndProject: a bounded top-n per
    partition, then a merge of n rows per partition — never a full sort)."""
    o = F.col(c).desc_nulls_last() if largest else F.col(c).asc_nulls_last()
    return df.orderBy(o, *[F.col(t) for t in tie_break]).limit(n)


PROFILE_PROBS = (0.05, 0.25, 0.5, 0.75, 0.95)
SKETCH_ITEMS = 8192        # items that a frequent-items sketch tracks: its error is below a 2,000th of the rows


def unpivot(df: DataFrame, cols: Sequence[str], kind: str) -> DataFrame:
    """(column, value) of every cell that is not null, in one scan."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast(kind).alias("value")) for c in cols])
    return df.select(F.inline(cells)).where("value is not null")


def top_values(df: DataFrame, cols: Sequence[str] | None = None, k: int = 5, support: float = 0.005) -> DataFrame:
    """(column, top): the ``k`` most frequent values of each column among those that fill at least ``support`` of
    the rows, as text with exact counts; more frequent ones first, then by value.

    Exact in two passes whatever the number of different values.  A mergeable frequent-items sketch for each column
    names every value of that support (and at most a few hundred others); the second pass counts only those, with
    partial sums before its shuffle.  So a column of unique values sends nothing but its sketch.  ``support`` must be
    at least 0.005, ten times the error of the sketch, which bounds the candidates that are broadcast."""
    if support < 0.005:
        raise ValueError("support must be at least 0.005")
    cols = list(cols or df.columns)
    sketches = [F.expr(f"approx_top_k(cast(`{c}` as string), {SKETCH_ITEMS}, {SKETCH_ITEMS})").alias(f"__t{i}") for i, c in enumerate(cols)]
    row = df.agg(F.count(F.lit(1)).alias("__rows"), *sketches)
    least = F.greatest(F.ceil(F.lit(float(support)) * F.col("__rows")), F.lit(1))
    found = F.array(*[F.struct(F.lit(c).alias("column"), F.filter(f"__t{i}", lambda x: x["item"].isNotNull() & (x["count"] >= least)).alias("items"))
                      for i, c in enumerate(cols)])
    wanted = (row.select(least.alias("least"), F.inline(found)).select("least", "column", F.explode("items").alias("x"))
              .select("least", "column", F.col("x.item").alias("value")))
    counts = (unpivot(df, cols, "string").join(F.broadcast(wanted), ["column", "value"])
              .groupBy("column", "value", "least").agg(F.count(F.lit(1)).alias("n")).where("n >= least"))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "value", "n"))), 1, k)
    return counts.groupBy("column").agg(F.transform(best, lambda x: F.struct(x["value"].alias("value"), x["n"].alias("n"))).alias("top"))


def profile(df: DataFrame, cols: Sequence[str] | None = None, probs: Sequence[float] = PROFILE_PROBS, k: int = 5,
            support: float = 0.005) -> DataFrame:
    """Per-column profile: type, rows, nulls, exact distinct count, min, max (as text), mean and exact quantiles
    (``quantiles``, in the order of ``probs``) for numerics, and the most frequent values (``top``, see
    :func:`top_values`; empty where no value has the support).  The quantiles of all columns come from one ordered
    pass over (column, value)."""
    cols = list(cols or df.columns)
    dtypes = dict(df.dtypes)
    numeric = {"int", "bigint", "double", "float", "smallint", "tinyint"}
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, c in enumerate(cols):
        v = F.col(f"`{c}`")
        aggs += [F.sum(v.isNull().cast("long")).alias(f"__n{i}"),
                 F.count_distinct(v).alias(f"__d{i}"),
                 F.min(v).cast("string").alias(f"__lo{i}"), F.max(v).cast("string").alias(f"__hi{i}"),
                 (F.avg(v) if dtypes[c] in numeric else F.lit(None).cast("double")).alias(f"__m{i}")]
    row = df.agg(*aggs)
    arr = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(dtypes[c]).alias("dtype"),
                             F.coalesce(f"__n{i}", F.lit(0)).cast("long").alias("n_null"),
                             F.col(f"__d{i}").cast("long").alias("n_distinct"),
                             F.col(f"__lo{i}").alias("min"), F.col(f"__hi{i}").alias("max"),
                             F.col(f"__m{i}").alias("mean")) for i, c in enumerate(cols)])
    out = row.select(F.col("__rows").cast("long").alias("n_rows"), F.inline(arr))
    numbers = [c for c in cols if dtypes[c] in numeric]
    if numbers:
        names = [f"__q{i}" for i in range(len(probs))]
        q = quantiles(unpivot(df, numbers, "double"), "value", probs, ["column"], names=names)
        out = out.join(q.select("column", F.array(*names).alias("quantiles")), "column", "left")
    else:
        out = out.withColumn("quantiles", F.lit(None).cast("array<double>"))
    none = F.array().cast("array<struct<value:string,n:bigint>>")
    return out.join(top_values(df, cols, k, support), "column", "left").withColumn("top", F.coalesce("top", none))


def score_buckets(df: DataFrame, score: str, target: str, q: int) -> DataFrame:
    """Mean / median of target per quantile bucket of score."""
    from acreage.operators.impute import qcut
    b = qcut(df, score, q, out="__bucket")
    return group_stats(b.where(F.col("__bucket_code").isNotNull()), target, "__bucket_code",
                       ("count", "mean", "median")).withColumnRenamed("__bucket_code", "bucket")
