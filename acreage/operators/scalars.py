"""Attach a one-row result (a global aggregate: fences, means, totals, the
corpus size, a query vector) to every row of a frame.

The one-row frame becomes a scalar subquery (``DataFrame.scalar()``): Spark
computes it once and inlines the value into the row expressions.  No join is
planned — in particular no cartesian / nested-loop join, which is what a join
on a constant key turns into.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_row(df: DataFrame, row: DataFrame, prefix: str = "") -> DataFrame:
    """Add every column of the one-row frame ``row`` to ``df`` (optionally
    renamed with ``prefix``).  ``row`` must produce exactly one row (a global
    aggregate does by construction)."""
    cols = row.columns
    sq = row.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("__row")).scalar()
    out = df.withColumn("__row", sq)
    return out.select("*", *[F.col("__row").getField(c).alias(prefix + c) for c in cols]).drop("__row")
