"""Texts of a table that lies in one file are parsed by more than one task."""

from acreage.operators.partitioning import dealt
from acreage.plans import q_features, q_parse


def test_price_profile_of_one_file_is_dealt_over_the_cores(spark, tmp_path):
    rows = [(i, "LARGE" if i % 2 else "SMALL", i % 50 + 1, 900.0 + i) for i in range(300)]
    spark.createDataFrame(rows, "p_partkey bigint, p_type string, p_size int, p_retailprice double").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    got = q_parse.price_profile(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    assert sorted(r["p_partkey"] for r in got.collect()) == list(range(300))


def test_rows_of_a_task_are_bounded_and_small_tables_stay(spark, tmp_path, monkeypatch):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    sizes = dealt(t, 100).rdd.glom().map(len).collect()
    assert len(sizes) == 10 and sum(sizes) == 1000 and max(sizes) <= 120
    assert dealt(t, 1000) is t
    seen = []
    monkeypatch.setattr(q_features, "dealt", lambda df: seen.append(df.columns) or df)
    rows = [(i, "LARGE", i % 50 + 1, 900.0 + i) for i in range(60)]
    spark.createDataFrame(rows, "p_partkey bigint, p_type string, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    assert sum(r["n"] for r in q_features.furnish_clusters(spark, str(tmp_path)).collect()) == 60 and len(seen) == 1
