"""Amenity medians order only the rows of the value buckets that hold a middle rank (round 3, F20, F21, F24)."""

import numpy as np

from acreage import session
from acreage.operators import features, ordered


def test_only_asked_buckets_are_ordered(spark, monkeypatch):
    monkeypatch.setattr(ordered, "bucket_number", lambda df: 64)
    stored, real = [], session.cut_lineage

    def cut(df):
        out = real(df)
        stored.append(out.count())
        return out
    monkeypatch.setattr(session, "cut_lineage", cut)
    rng = np.random.default_rng(3)
    rows = []
    for i in range(6000):
        has = [str(a) for a in rng.choice(["gym", "pool", "lift", "park"], size=rng.integers(0, 4), replace=False)] + ["door"]
        rate = None if i % 50 == 0 else float(rng.lognormal(8, 0.5)) if i % 3 else 2980.0        # many rows of one value
        rows.append((i // 2, rate, None if i % 97 == 0 else has + has[:1] + [None] + (["attic"] if i % 1000 == 7 else []) + (["ghost"] if rate is None else [])))
    df = spark.createDataFrame(rows, "k long, rate double, am array<string>")
    w = {r["amenity"]: r for r in features.amenity_weights(df, "k", "am", "rate", 30).collect()}
    assert set(w) == {"gym", "pool", "lift", "park", "door", "attic", "ghost"}
    for a, r in w.items():
        of = lambda inside: [x for _, x, am in rows if x is not None and (am is not None and a in am) == inside]  # noqa: B023, E731
        assert r["n_present"] == sum(am is not None and a in am for _, _, am in rows)
        assert r["median_present"] == (float(np.median(of(True))) if of(True) else None)
        assert r["median_absent"] == (float(np.median(of(False))) if of(True) else None)
    assert max(stored) < len(rows) / 4


def test_no_rows_and_one_value(spark):
    none = spark.createDataFrame([], "k long, rate double, am array<string>")
    assert features.amenity_weights(none, "k", "am", "rate", 0).count() == 0
    one = spark.createDataFrame([(1, 5.0, ["a"]), (2, 5.0, ["b"]), (3, 5.0, ["a", "b"])], "k long, rate double, am array<string>")
    got = {r["amenity"]: (r["n_present"], r["median_present"], r["median_absent"], r["weight"]) for r in features.amenity_weights(one, "k", "am", "rate", 0).collect()}
    assert got == {"a": (2, 5.0, 5.0, 0.0), "b": (2, 5.0, 5.0, 0.0)}
