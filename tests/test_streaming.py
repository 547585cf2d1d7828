"""Streaming wrappers agree with the batch operators."""

import os
import tempfile

from pyspark.sql import functions as F

from acreage.sources import io
from acreage.streaming import incremental as S

SF = "/root/testdata/sf0.001"


def test_merge_latest_matches_batch(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_id", "ts", "event_type", "value")
    root = tempfile.mkdtemp(prefix="acreage-stream-")
    src = os.path.join(root, "in")
    # three micro-batches written as files
    for i, (lo, hi) in enumerate([(0, 60), (40, 120), (100, 10_000)]):
        events.where((F.col("value") >= lo) & (F.col("value") < hi)).write.parquet(os.path.join(src, f"b{i}"))
    stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").parquet(src)
    out = os.path.join(root, "latest")
    q = (stream.writeStream.foreachBatch(S.merge_latest_into(out, "user_id", ["ts", "event_id"]))
               .option("checkpointLocation", os.path.join(root, "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = {r["user_id"]: r["event_id"] for r in S.read_latest(spark, out).collect()}
    # batch answer: the latest event per user over everything
    exp = {r["user_id"]: r["event_id"] for r in
           io.upsert_latest(events.limit(0), events, "user_id", ["ts", "event_id"]).collect()}
    assert got == exp


def test_latest_per_key_stream(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_id", "ts", "value")
    root = tempfile.mkdtemp(prefix="acreage-stream-")
    events.write.parquet(os.path.join(root, "in"))
    stream = spark.readStream.schema(events.schema).parquet(os.path.join(root, "in"))
    agg = S.latest_per_key(stream, "user_id", ["ts", "event_id"])
    q = (agg.writeStream.outputMode("update").format("memory").queryName("latest_ev")
            .option("checkpointLocation", os.path.join(root, "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = {r["user_id"]: r["event_id"] for r in spark.sql("select * from latest_ev").collect()}
    exp = {r["user_id"]: r["event_id"] for r in
           io.upsert_latest(events.limit(0), events, "user_id", ["ts", "event_id"]).collect()}
    assert got == exp


def test_score_stream_matches_batch(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    orders = spark.read.parquet(f"{SF}/orders.parquet").select(
        "o_orderkey", F.log1p(F.col("o_totalprice") / 1e5).alias("label"), (F.col("o_custkey") % 7).cast("double").alias("x"))
    model = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"), LinearRegression()]).fit(orders)
    root = tempfile.mkdtemp(prefix="acreage-stream-")
    orders.write.parquet(os.path.join(root, "in"))
    stream = spark.readStream.schema(orders.schema).parquet(os.path.join(root, "in"))
    scored = S.score_stream(stream, model, 0.15)
    q = (scored.select("o_orderkey", "price", "low", "high").writeStream.format("memory").queryName("scored_orders")
               .option("checkpointLocation", os.path.join(root, "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    from acreage.ml.train import predict_band
    exp = {r["o_orderkey"]: (r["price"], r["high"]) for r in predict_band(model.transform(orders), 0.15).collect()}
    got = {r["o_orderkey"]: (r["price"], r["high"]) for r in spark.sql("select * from scored_orders").collect()}
    assert got == exp


def test_merge_keeps_rows_on_a_uri_path(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    merge = S.merge_latest_into(path, "k", ["v"])
    merge(spark.createDataFrame([(1, 1), (2, 1)], "k int, v int"), 0)
    merge(spark.createDataFrame([(3, 1), (1, 5)], "k int, v int"), 1)
    merge(spark.createDataFrame([(3, 1), (1, 5)], "k int, v int"), 1)      # a repeated batch
    assert sorted(map(tuple, S.read_latest(spark, path).collect())) == [(1, 5), (2, 1), (3, 1)]
    assert S.versions(spark, path) == [0, 1]
