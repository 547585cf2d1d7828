"""Column profiles against plain Python: exact quantiles and frequent values, columns of unique values."""

import math
import random
from collections import Counter

import pytest

from acreage.operators import stats


def frequent(values, rows, k, support):
    counts = Counter(v for v in values if v is not None)
    least = max(1, math.ceil(support * rows))
    return sorted(((v, n) for v, n in counts.items() if n >= least), key=lambda x: (-x[1], x[0]))[:k]


def test_top_values_are_exact_beyond_the_sketch(spark):
    """30,000 different values and a few frequent ones, dealt over many partitions."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30_000)] + ["hot"] * 9_000 + ["warm"] * 400 + ["edge"] * 201 + ["below"] * 199 + [None] * 200
    rng.shuffle(words)
    rows = words[:40_000]
    df = spark.createDataFrame([(w, i) for i, w in enumerate(rows)], "w string, id int").repartition(16)
    got = {r["column"]: [(x["value"], x["n"]) for x in r["top"]] for r in stats.top_values(df, ["w", "id"], k=3).collect()}
    assert got == {"w": frequent(rows, 40_000, 3, 0.005)}
    assert [v for v, _ in got["w"]] == ["hot", "warm", "edge"]


def test_profile_of_ties_nulls_and_odd_names(spark):
    rows = [("a", 1, 1.5), ("b", 2, None), ("a", 3, 2.5), ("b", 4, None), (None, 100, 9.0)]
    df = spark.createDataFrame(rows, "`x.y` string, value int, column double")
    got = {r["column"]: r for r in stats.profile(df, probs=(0.0, 0.5, 0.9), k=2).collect()}
    assert [(t["value"], t["n"]) for t in got["x.y"]["top"]] == [("a", 2), ("b", 2)]
    assert got["x.y"]["quantiles"] is None and got["x.y"]["n_null"] == 1
    assert got["value"]["quantiles"] == pytest.approx([1.0, 3.0, 61.6])
    assert got["column"]["quantiles"] == pytest.approx([1.5, 2.5, 7.7]) and got["column"]["mean"] == pytest.approx(13 / 3)


def test_profile_of_an_empty_table_and_of_nulls(spark):
    df = spark.createDataFrame([], "a int, b string")
    assert [(r["n_rows"], r["n_null"], r["n_distinct"], r["quantiles"], r["top"]) for r in stats.profile(df).collect()] == [(0, 0, 0, None, [])] * 2
    df = spark.createDataFrame([(None, None)], "a int, b string")
    assert [(r["n_rows"], r["n_null"], r["quantiles"], r["top"]) for r in stats.profile(df).collect()] == [(1, 1, None, [])] * 2
    with pytest.raises(ValueError):
        stats.top_values(df, support=0.001)
