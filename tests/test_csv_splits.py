"""Multi-line CSV read in splits, against Spark's reader that gives a file to one task."""

import csv
import random

import pytest
from pyspark.sql import types as T

from acreage.sources import csv_splits, io

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n", T.DoubleType()), T.StructField("note", T.StringType())])


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "1"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def field(rng):
    parts = ["a", "word", ",", "\n", "\n\n", '"', '""', "é漢", " ", "x,y", "'", "\\", "long " * 30]
    return "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 2, 5, 9])))


def write(path, seed, rows, end="\n", quoting=csv.QUOTE_MINIMAL):
    rng = random.Random(seed)
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, lineterminator=end, quoting=quoting)
        out.writerow(["id", "text", "n\nof" if seed % 2 and end == "\n" else "n", "note"])
        for i in range(rows):
            out.writerow([i, field(rng), rng.choice(["1.5", "", "7"]), field(rng)])


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_equal_to_the_reader_of_whole_files(spark, small_splits, tmp_path, end):
    for seed in range(4):
        write(tmp_path / f"part{seed}.csv", seed, 60, end, csv.QUOTE_ALL if seed == 3 else csv.QUOTE_MINIMAL)
    got = csv_splits.read_csv_split(spark, str(tmp_path), SCHEMA)
    want = io.read_csv(spark, str(tmp_path), SCHEMA)
    as_rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    assert len(as_rows(want)) == 240
    assert as_rows(got) == as_rows(want)
    assert spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions() > 8
    assert csv_splits.records(spark, str(tmp_path)).select("file", "start").distinct().count() > 40


def test_a_field_longer_than_many_splits(spark, small_splits, tmp_path):
    text = "line, \"quoted\"\n" * 300
    with open(tmp_path / "a.csv", "w", newline="") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerows([["id", "text", "n", "note"], [1, "x", 2.0, "y"], [2, text, 3.0, "z"], [3, "", 4.0, "last"]])
    got = sorted(map(tuple, csv_splits.read_csv_split(spark, str(tmp_path / "a.csv"), SCHEMA).collect()))
    assert [r[0] for r in got] == [1, 2, 3] and got[1] == (2, text, 3.0, "z")


def test_bad_records_empty_lines_and_missing_path(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text,n,note\n1,"a\nb",2,c\n\nx,"d",3,e\n5,f\n6,"never\nended,7\n')
    got = csv_splits.read_csv_split(spark, str(tmp_path / "a.csv"), SCHEMA, corrupt=True).collect()
    want = io.read_csv(spark, str(tmp_path / "a.csv"), SCHEMA, corrupt=True).collect()
    assert sorted((r.id, r.text) for r in got if r.id == 1) == [(1, "a\nb")]
    assert len(got) == len(want) and sum(r._corrupt_record is not None for r in got) == sum(r._corrupt_record is not None for r in want)
    (tmp_path / "empty.csv").write_text("")
    assert csv_splits.read_csv_split(spark, str(tmp_path / "empty.csv"), SCHEMA).collect() == []
    with pytest.raises(Exception, match="(?i)path|exist"):
        csv_splits.read_csv_split(spark, str(tmp_path / "none.csv"), SCHEMA).collect()
