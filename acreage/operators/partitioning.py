"""Partitioning helpers.

``spread`` protects CPU-heavy per-row work (tokenising whole documents,
regex parsing of pages) from inputs that arrive in fewer partitions than the
cluster has cores — e.g. a file written as a single row group.  It only adds a
(round-robin, deterministic) repartition when the scan is under-partitioned;
on a large table with many splits it is a no-op, so no shuffle is added at
scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, keys=None, min_partitions: int | None = None) -> DataFrame:
    """Repartition an under-partitioned input.  With ``keys`` the rows are
    hash-partitioned on them (deterministic, no sort of wide text rows);
    without, round-robin."""
    sc = df.sparkSession.sparkContext
    want = min_partitions or sc.defaultParallelism
    if df.rdd.getNumPartitions() < want:
        if keys:
            return df.repartition(want, *([keys] if isinstance(keys, str) else list(keys)))
        return df.repartition(want)
    return df


def dealt(df: DataFrame, most: int = 100_000) -> DataFrame:
    """Repartition (round-robin) a stored table whose scan has fewer partitions than one for each ``most`` rows, so that what a
    task holds is bounded by rows, not by file size.  Smaller tables stay as they are read, which matters to fits whose random
    starts depend on the partitions."""
    want = -(-df.count() // most)
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df
