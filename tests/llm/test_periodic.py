"""Operator 11 against a plain search of all periods."""

import random
import zlib
from hashlib import sha256

import numpy as np
import pytest

from acreage.llm import oracles, periodic
from acreage.llm.queries import QUERIES

BLANKS = " \t\n\x0b\x0c\r"


def plain_runs(w, least_length=6, least_repeats=4):
    out = []
    for q in range(1, len(w) // least_repeats + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i - s + q
            if n >= max(least_length, least_repeats * q) and not any(p < q and a <= s and a + m >= s + n for a, m, p in out):
                out.append((s, n, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def looped(key, words):
    h = zlib.crc32(str(key).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def words_of(text):
    for c in BLANKS[1:]:
        text = (text or "").replace(c, " ")
    return [w for w in text.split(" ") if w]


def random_words(rng, size):
    w = [rng.randrange(rng.choice([1, 2, 3, 40])) for _ in range(size)]
    if size and rng.random() < 0.7:
        p, s = rng.randrange(1, max(2, size // 4)), rng.randrange(size)
        for i in range(s + p, size):
            w[i] = w[i - p]
    return w


@pytest.mark.parametrize("least", [(6, 4), (6, 3), (12, 5)])
def test_runs_equal_a_search_of_all_periods(least):
    rng = random.Random(11)
    for _ in range(400):
        w = random_words(rng, rng.randrange(150))
        assert periodic.find_runs(np.array(w, dtype=np.int64), *least) == plain_runs(w, *least)


def test_fibonacci_words_and_single_letters():
    a, b = "a", "ab"
    while len(b) < 2000:
        a, b = b, b + a
    for text in (b[:1500], "a" * 3000, "ab" * 900 + "c" + "ab" * 5, "abcabcabcab" * 40):
        w = np.array([ord(c) for c in text], dtype=np.int64)
        assert periodic.find_runs(w) == plain_runs(w.tolist())


def test_runs_do_not_cross_texts_of_a_group():
    rows = list(periodic.of_texts([b"x x x", b"x x x x", b"", b"y " * 6]))
    assert [r for _, r, _ in rows] == [[], [], [], [(0, 6, 1)]]
    assert rows[3] == (6, [(0, 6, 1)], b"y")


def test_long_text_beyond_a_group(spark):
    rng = random.Random(3)
    loop = [f"w{rng.randrange(10 ** 9)}" for _ in range(20_000)]
    text = " ".join([f"v{i}" for i in range(100_000)] + loop * 5)
    assert len(text) > periodic.GROUP
    row = periodic.detect(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in row["runs"]] == [(100_000, 100_000, 20_000)]
    assert row["collapsed"].split() == [f"v{i}" for i in range(100_000)] + loop


def test_defined_results(spark):
    rows = [(1, None, "x"), (2, "", "x"), (2, " \n\t ", "x"), (None, "a b " * 4, "x"), (3, "a b " * 4, "x"), (3, "a b " * 4, "x"), (4, "a b \u0085 c", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string").selectExpr("*", "1 as n_words", "2 as collapsed", "3 as words")
    got = sorted(((r["doc_id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.detect(docs).collect()), key=repr)
    run = (8, [(0, 8, 2)], "a b")
    assert got == sorted([(1, 0, [], ""), (2, 0, [], ""), (2, 0, [], ""), (0, *run), (3, *run), (3, *run), (4, 3, [], "a b \u0085 c")], key=repr)
    assert periodic.detect(docs.limit(0)).count() == 0
    assert periodic.with_loop(docs).columns == ["doc_id", "text"]


def test_query_against_plain_python(spark, tmp_path):
    rng = random.Random(5)
    texts = [" ".join("abcdefgh"[x % 8] for x in random_words(rng, rng.randrange(200))) for _ in range(300)]
    rows = list(enumerate([None, "", "\n", *texts]))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for key, text in rows:
        w = looped(key, words_of(text))
        runs = plain_runs(w)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        r = got[key]
        assert r["n_runs"] == len(runs)
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r["runs_sha256"] == sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()


def test_query_equals_sql(spark):
    from acreage.plans.check import duck
    sf = "/root/testdata/sf0.001"
    e = duck(sf).execute(oracles.PERIODIC)
    names = [c[0] for c in e.description]
    assert sorted(map(repr, e.fetchall())) == sorted(repr(tuple(r)) for r in QUERIES["op11_periodic_runs"](spark, sf).select(*names).collect())
