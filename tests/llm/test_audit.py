"""Operator 13 against plain Python."""

import random
import re
from itertools import permutations

import numpy as np

from acreage.llm import audit, oracles
from acreage.llm.queries import QUERIES


def plain_measures(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return [len(w), len(set(w)), len(re.findall("[A-Z]", t)), len(t), len(re.findall("[#$%&*|]", t))]


def plain_audit(docs, labels):
    failing = []
    for key, text, source in docs:
        n, distinct, caps, points, signs = plain_measures(text)
        copy = any(k is not None and key is not None and k < key and (t or "") == (text or "") for k, t, _ in docs)
        bits = {f for f, x in zip("ABCDE", (n < 200, 100 * distinct < 50 * n, 100 * caps > 2 * points, signs > 0, copy)) if x}
        failing.append((source or "", bits, any(k is not None and k == key and q == 1 for k, q, _ in labels),
                        any(k is not None and k == key and x == 1 for k, _, x in labels)))
    out = []
    for part in {s for s, *_ in failing}:
        rows = [x[1:] for x in failing if x[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        steps = []
        for order in permutations("ABCDE"):
            left = rows
            for i, f in enumerate(order):
                gone = [x for x in left if f in x[0]]
                redundant = sum(1 for x in rows if f in x[0] and x[0] & set(order[:i]))
                left = [x for x in left if f not in x[0]]
                shapley[f] += len(gone)
                steps.append((part, "".join(order), i + 1, len(left), len(gone), redundant, sum(1 for x in rows if x[0] == {f}),
                              sum(1 for x in gone if x[1]), sum(1 for x in gone if x[2]), f))
        out += [(*s[:-1], shapley[s[-1]]) for s in steps]
    return sorted(out)


def random_text(rng):
    n = rng.choice([0, 3, 150, 250, 400])
    words = ["ab", "äö", "Cap", "x" * 70, "x" * 69 + "y", "中", "a#", "b", " ", "CAPS", "é", "\U0001f600"] + [f"w{i}" for i in range(rng.choice([5, 400]))]
    return "".join(rng.choice(words) + rng.choice(" \n\t\x0b\r\x1f ") for _ in range(n))


def test_one_pass_counts():
    rng = random.Random(2)
    texts = [random_text(rng) for _ in range(200)] + ["", "a", " ", "a a", "b"]
    assert audit.of_texts(t.encode() for t in texts).tolist() == [plain_measures(t) for t in texts]


def test_texts_beyond_a_segment(monkeypatch):
    monkeypatch.setattr(audit, "SEGMENT", 1000)
    monkeypatch.setattr(audit, "cut_points", lambda data, member: __import__("acreage.llm.common", fromlist=["x"]).cut_points(data, member, 1000))
    rng = random.Random(4)
    texts = [random_text(rng) for _ in range(60)] + ["y" * 5000, "z " * 3000]
    assert audit.of_texts(t.encode() for t in texts).tolist() == [plain_measures(t) for t in texts]


def test_hash_table_compares_words(monkeypatch):
    """All words share one hash: the table still tells them apart."""
    monkeypatch.setattr(audit, "mix", lambda h: np.zeros_like(h))
    texts = ["a b a c " + "q" * 90 + " " + "q" * 89 + "r " + "q" * 90, "a a b"]
    assert audit.of_texts(t.encode() for t in texts)[:, 1].tolist() == [5, 2]


def test_interactions_against_plain_python(spark):
    rng = random.Random(8)
    texts = [random_text(rng) for _ in range(30)] + [None, ""]
    docs = [(i if rng.random() < 0.95 else None, rng.choice(texts), rng.choice(["a", "b", None])) for i in range(300)]
    docs += docs[:20]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 300, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 as mask", "2 as part", "3 as digest", "4 as n", "5 as good")
    got = audit.interactions(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    names = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    assert sorted(tuple(r) for r in got.select(*names).collect()) == plain_audit(docs, labels)


def test_empty_table(spark):
    d = spark.createDataFrame([], "doc_id long, text string, source string")
    assert audit.interactions(d, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_query_equals_sql(spark):
    from acreage.plans.check import duck
    sf = "/root/testdata/sf0.001"
    e = duck(sf).execute(oracles.AUDIT)
    names = [c[0] for c in e.description]
    assert sorted(map(repr, e.fetchall())) == sorted(repr(tuple(r)) for r in QUERIES["op13_filter_audit"](spark, sf).select(*names).collect())
