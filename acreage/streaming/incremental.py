"""Structured Streaming forms of the incremental operators.

The reference scrapes in batches, appends each batch to a CSV, drops
duplicate links keeping the last one, and skips links already done (A6/A7);
prices are predicted per request (K23).  Here:

* ``latest_per_key`` — a streaming ``max_by`` aggregation (state: one row per
  key in the state store, no window over a key's history);
* ``merge_latest_into`` — a ``foreachBatch`` sink that folds each micro-batch
  into a Parquet table with :func:`acreage.sources.io.upsert_latest`, cutting
  lineage with a reliable checkpoint before the overwrite;
* ``pending_stream`` — stream-static left-anti join against done links;
* ``score_stream`` — a fitted ``PipelineModel`` applied to a stream plus the
  price band.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreage.sources.io import upsert_latest


def latest_per_key(stream: DataFrame, key: Sequence[str] | str, order: Sequence[str],
                   watermark: tuple[str, str] | None = None) -> DataFrame:
    """Keep the row with the largest ``order`` per key (update output mode)."""
    keys = [key] if isinstance(key, str) else list(key)
    s = stream.withWatermark(*watermark) if watermark else stream
    payload = F.struct(*[F.col(c) for c in s.columns if c not in keys])
    g = s.groupBy(*keys).agg(F.max_by(payload, F.struct(*[F.col(c) for c in order])).alias("__row"))
    return g.select(*keys, "__row.*")


def versions(spark, path: str) -> list[int]:
    """Complete versions of a table at ``path``, ascending; asks the path's own file system."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    numbers = sorted(int(n.split("=")[1]) for n in names if n.startswith("version="))
    return [n for n in numbers if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/version={n}/_SUCCESS"))]


def read_latest(spark, path: str, before: int | None = None) -> DataFrame | None:
    """The newest complete version (below ``before``), None if there is none."""
    known = [n for n in versions(spark, path) if before is None or n < before]
    return spark.read.parquet(f"{path}/version={known[-1]}") if known else None


def merge_latest_into(path: str, key: Sequence[str] | str, order: Sequence[str]):
    """foreachBatch function: upsert the micro-batch into the table at ``path`` (batch
    rows win; within a batch the larger ``order`` wins).  Each batch writes a version of
    its own and leaves the others alone, so a failed or repeated batch loses nothing;
    ``read_latest`` gives the newest complete one."""

    def _merge(batch: DataFrame, batch_id: int):
        existing = read_latest(batch.sparkSession, path, before=batch_id)
        if existing is None:
            merged = upsert_latest(batch.limit(0), batch, key, order)
        else:
            merged = upsert_latest(existing, batch.select(*existing.columns), key, order)
        merged.write.mode("overwrite").parquet(f"{path}/version={batch_id}")

    return _merge


def pending_stream(links: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Streaming links minus the (static) table of processed links."""
    return links.join(done.select(key).distinct(), key, "left_anti")


def score_stream(stream: DataFrame, model, mape: float, log_target: bool = True) -> DataFrame:
    """Apply a fitted pipeline to a stream and attach the price band."""
    from acreage.ml.train import predict_band
    return predict_band(model.transform(stream), mape, "prediction", log_target)
