"""K2-K4: reproducible splits by a hash order (the same order in DuckDB).

A global split compares each row with the ends of its parts, which a count by leading
bits of the hash finds; ranks of strata come from the skew-safe ordered primitive.  So no split
ever sorts a whole table (or a whole stratum) in one task.  The order key is the first 60 bits of md5("<key>:<seed>"); ties are
broken by the key itself.
"""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acreage.operators.ordered import hash_order, row_ranks


def _ranked(df: DataFrame, key: str, seed: int, by=None) -> DataFrame:
    d = df.withColumn("__h", hash_order([key], seed))
    return row_ranks(d, "__h", by, tie_break=[key], out="__rank").drop("__h")


def _ends(d: DataFrame, key: str, sizes) -> list[tuple] | None:
    """(hash, key) of the last row of each of the numbers of rows ``sizes(n)``, n being the rows of ``d``, in order of hash and key;
    None for no row at all.  One count by the hash's 12 leading bits, then the rows of the buckets that an end falls into (each about
    1 / 4096 of the rows) are put in order: no row of ``d`` is shuffled or sorted.  Returns None if an end falls between rows that are equal in both."""
    top = F.shiftright("__h", 48)
    counts = sorted((r["b"], r["n"]) for r in d.groupBy(top.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect())
    wanted = sizes(sum(n for _, n in counts))
    asked, before, found = set(), 0, {}
    for b, n in counts:
        asked |= {(b, w - before, w) for w in wanted if before < w <= before + n}
        before += n
    if asked:
        equal = d.where(top.isin(sorted({b for b, _, _ in asked}))).groupBy(top.alias("b"), "__h", F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        upto = equal.withColumn("upto", F.sum("n").over(Window.partitionBy("b").orderBy("__h", "k").rowsBetween(Window.unboundedPreceding, 0)))
        hits = [(F.col("b") == b) & (F.col("upto") >= r) & (F.col("upto") - F.col("n") < r) for b, r, _ in sorted(asked)]
        for row in upto.where(functools.reduce(operator.or_, hits)).collect():
            for b, r, w in asked:
                if row["b"] == b and row["upto"] - row["n"] < r <= row["upto"]:
                    if row["upto"] != r:
                        return None
                    found[w] = (row["__h"], row["k"])
    return [found.get(w) for w in wanted]


def _upto(key: str, end: tuple | None) -> Column:
    """Is the row not after this end?"""
    if end is None:
        return F.lit(False)
    same = F.col(key).isNull() if end[1] is None else F.col(key).isNull() | (F.col(key) <= F.lit(end[1]))
    return (F.col("__h") < end[0]) | ((F.col("__h") == end[0]) & same)


def holdout(df: DataFrame, key: str, test_frac: float = 0.2, seed: int = 42, out: str = "is_test") -> DataFrame:
    """K2: exactly ceil(test_frac * n) rows (lowest hash order) go to test."""
    d = df.withColumn("__h", hash_order([key], seed))
    ends = _ends(d, key, lambda n: [math.ceil(n * test_frac)])
    if ends is None:
        r = _ranked(df, key, seed)
        n_test = F.ceil(F.col("_tot") * F.lit(test_frac))
        return r.withColumn(out, F.col("__rank") <= n_test).drop("__rank", "_tot")
    return d.withColumn(out, _upto(key, ends[0])).drop("__h")


def stratified(df: DataFrame, key: str, strata: str, test_frac: float = 0.2, seed: int = 42,
               out: str = "is_test") -> DataFrame:
    """K3: per stratum, round(test_frac * n_stratum) rows (half-up) go to test."""
    r = _ranked(df, key, seed, by=strata)
    n_test = F.floor(F.col("_tot") * F.lit(test_frac) + F.lit(0.5))
    return r.withColumn(out, F.col("__rank") <= n_test).drop("__rank", "_tot")


def kfold(df: DataFrame, key: str, k: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    """K4: shuffled k-fold like sklearn ``KFold``: the first n % k folds get
    n // k + 1 rows, the rest n // k, in hash order."""
    def sizes(n):
        small, rem = divmod(n, k)
        return [(f + 1) * small + min(f + 1, rem) for f in range(k - 1)]

    d = df.withColumn("__h", hash_order([key], seed))
    ends = _ends(d, key, sizes)
    if ends is not None:
        return d.withColumn(out, sum(((~_upto(key, e)).cast("int") for e in ends), F.lit(0))).drop("__h")
    r = _ranked(df, key, seed)
    n, rk = F.col("_tot"), F.col("__rank") - 1
    small = F.floor(n / k)
    rem = n - small * k
    big_rows = rem * (small + 1)
    fold = F.when(rk < big_rows, F.floor(rk / (small + 1))).otherwise(rem + F.floor((rk - big_rows) / small))
    return r.withColumn(out, fold.cast("int")).drop("__rank", "_tot")


def split_shares(df: DataFrame, bin_col: str, flag: str = "is_test") -> DataFrame:
    """K3 check: share of each bin in train and in test."""
    g = df.groupBy(bin_col).agg(F.sum((~F.col(flag)).cast("long")).alias("n_train"),
                                F.sum(F.col(flag).cast("long")).alias("n_test"))
    w = Window.partitionBy()
    return g.withColumn("train_share", F.col("n_train") / F.sum("n_train").over(w)).withColumn(
        "test_share", F.col("n_test") / F.sum("n_test").over(w))


def expected_test_rows(n: int, frac: float = 0.2) -> int:
    return math.ceil(n * frac)
