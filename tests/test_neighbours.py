"""The k nearest items of all items against a comparison of all pairs."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from acreage.operators import neighbours

SCHEMA = "item long, term string, weight double"


def vectors(texts):
    df = Counter(t for text in texts.values() for t in set(text.split()))
    rows = []
    for key, text in texts.items():
        tf = {t: n * (math.log((1 + len(texts)) / (1 + df[t])) + 1) for t, n in Counter(text.split()).items()}
        norm = math.sqrt(sum(w * w for w in tf.values()))
        rows += [(key, t, w / norm) for t, w in sorted(tf.items())]
    return rows


def brute(rows, k):
    by = defaultdict(dict)
    for key, t, w in rows:
        by[key][t] = round(w, 12)
    out = []
    for a, va in by.items():
        found = [(-round(sum(w * vb[t] for t, w in va.items() if t in vb), 9), b) for b, vb in by.items() if b != a and va.keys() & vb.keys()]
        out += [(a, b, -s, r + 1) for r, (s, b) in enumerate(sorted(found)[:k])]
    return out


def texts(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    out = {i * 7 + 1: " ".join(rng.choices(words, weights, k=rng.choice([1, 2, 6, 30]))) for i in range(n)}
    for i in range(0, n, 9):                       # near copies
        out[100_000 + i] = out[i * 7 + 1] + " w399"
    for i in range(60):                            # a hot group of equal items, in other words' order
        out[200_000 + i] = "alpha beta gamma w1"
    out[300_000] = "alone"
    return out


@pytest.mark.parametrize("k", [1, 4])
def test_nearest_equals_all_pairs(spark, k):
    rows = vectors(texts(k, 250))
    got = neighbours.nearest(spark.createDataFrame(rows, SCHEMA).repartition(5), "item", k).collect()
    want = brute(rows, k)
    assert {(r.item, r["rank"]): r.neighbour for r in got} == {(a, r): b for a, b, _, r in want}
    score = {(a, r): s for a, _, s, r in want}
    assert all(abs(score[r.item, r["rank"]] - r.score) < 1e-8 for r in got)


def test_bounds_open_few_pairs(spark):
    """Groups of items with a vocabulary of their own, and words that all have: far fewer pairs than share a word."""
    rng = random.Random(5)
    items = {g * 100 + i: " ".join([f"g{g}_{rng.randrange(12)}" for _ in range(8)] + rng.choices(["the", "of", "and"], k=3)) for g in range(30) for i in range(20)}
    rows = spark.createDataFrame(vectors(items), "x long, f string, w double")
    v = neighbours.bounded_vectors(rows)
    pairs = neighbours.candidate_pairs(v, neighbours.floors(v, 3, 4)).count()
    meet = v.alias("a").join(v.alias("b"), "f").where("a.x != b.x").select(F.col("a.x"), F.col("b.x")).distinct().count()
    assert meet > 300_000 and pairs < meet / 10


def test_edge_cases(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert neighbours.nearest(empty, "item", 3).collect() == []
    rows = [(1, "a", 1.0), (2, "a", 1.0), (None, "a", 1.0), (3, None, 1.0), (4, "a", 0.0), (5, "b", 1.0)]
    got = neighbours.nearest(spark.createDataFrame(rows, SCHEMA), "item", 3).collect()
    assert sorted(map(tuple, got)) == [(1, 2, 1.0, 1), (2, 1, 1.0, 1)]
