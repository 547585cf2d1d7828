"""Operators 4 and 7 against plain Python."""

import hashlib
import random
import re
from collections import Counter

import pytest

from acreage.llm import quality, secrets

SCHEMA = "doc_id bigint, text string, lang string, source string, n_words string, spans int, kind int"
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def rows():
    random.seed(11)
    bits = ["password=abcdefgh1", "Token: 'short'", "secret: api_key: \"XXXXXXXXX\"", "API_KEY=\"A1b2C3d4E5\"", "AKIA" + "Z9" * 8, "AKIAshort", "AKIA1234",
            "deadbeef" * 4, "deadbeef" * 3, "ghp_" + "a1" * 18, "xoxb-1234567890-ab", "é漢字", "😀", "\n", "\n", "word", "lorem", "ipsum", "dolor", "#", "|", "passwd==abc12345",
            "AIza" + "x" * 35, "sk_live_" + "0a" * 9, "-----BEGIN RSA PRIVATE KEY-----", "eyJabcdefgh1.eyJabcdefgh2.abcdefgh3", "token:token=longvalue123"]
    out = [(i, " ".join(random.choice(bits) for _ in range(random.choice([1, 5, 60, 200]))), random.choice(["en", "fr", None]), random.choice(["a", "b", None]), "x", 1, 2) for i in range(120)]
    out += [(1000, None, "en", "a", None, None, None), (1001, "", None, None, "", 0, 0), (None, "password=abcdefgh1 é", "en", "a", "", 0, 0), out[3], out[3],
            (1002, "x" * 50000 + " secret=" + "y" * 50000, "en", "a", "", 0, 0), (1003, "a b c d " * 5000, "en", "a", "", 0, 0), (1004, " \n\t ", "en", "a", "", 0, 0)]
    return out


def base_spans(text):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(found + [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])


def text_of(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)


def test_secret_scan(spark):
    from pyspark.sql import functions as F
    data = rows()
    got = secrets.scan(spark.createDataFrame(data, SCHEMA)).withColumn("line", secrets.joined(F.col("spans"))).collect()
    more = Counter()
    want, have = Counter(), Counter()
    for doc, text, *_ in data:
        spans = base_spans(text or "")
        for o, r in enumerate(secrets.MORE, 3):
            spans += [(m.start(), o, m.end(), r.kind) for m in re.finditer(r.regex, text or "")]
            more[r.kind] += len(spans)
        want[doc, text_of(sorted(spans))] += 1
    for r in got:
        have[r.doc_id, r.line] += 1
        assert [tuple(s) for s in r.spans] == sorted(tuple(s) for s in r.spans)
    assert have == want


def test_each_rule_found_by_its_trigrams(spark):
    samples = {"assign": "password=abcdefgh1", "access": "AKIA" + "Z9" * 8, "github": "ghp_" + "a1" * 18, "slack": "xoxb-1234567890-ab", "google": "AIza" + "x" * 35,
               "stripe": "sk_live_" + "0a" * 9, "jwt": "eyJabcdefgh1.eyJabcdefgh2.abcdefgh3", "private_key": "-----BEGIN PRIVATE KEY-----"}
    docs = spark.createDataFrame([(i, s) for i, s in enumerate(samples.values())], "doc_id bigint, text string")
    found = {r.doc_id: r.kinds for r in secrets.candidates(secrets.index(docs)).collect()}
    for i, kind in enumerate(samples):
        assert kind in found[i]
    assert secrets.trigram_query(secrets.BASE[2].regex) == []


@pytest.mark.parametrize("regex,words", [("(?i)ab(cd|ef)[xy]z?q", ["abcdxzq", "ABEFyq"]), ("foo.*barbaz", ["foo--barbaz"]), ("(abc)+[0-9]{2}key", ["abcabc12key"]), ("a{3}b{2,}cde", ["aaabbbcde"])])
def test_query_has_no_false_negative(regex, words):
    for w in words:
        assert re.fullmatch(regex, w)
        low = w.lower()
        for clause in secrets.trigram_query(regex):
            assert any(all(g in low for g in s) for s in clause)


def plain_measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    c = Counter(zip(w, w[1:], w[2:]))
    covered = {j + k for j in range(len(w) - 2) if c[w[j], w[j + 1], w[j + 2]] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark):
    data = rows() + [(2000, "a b c a b c x y \u0085 z", "en", "a", "", 0, 0), (2001, "l\n\nl\n l\nl", "en", "a", "", 0, 0)]
    got = Counter(tuple(r) for r in quality.judge(spark.createDataFrame(data, SCHEMA)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    want = Counter()
    for doc, text, *_ in data:
        m = plain_measures(text)
        want[(doc, *m, m[0] < 50 or 100 * m[4] > 50 * m[0])] += 1
    assert got == want


def test_quality_thresholds_adapt(spark):
    random.seed(4)
    def doc(noise):
        return " ".join("".join(random.choice("abcdefg") for _ in range(6)) + ("#" if random.random() < noise else "") for _ in range(120))
    data = [(i, doc(0.0), "en", "clean") for i in range(200)] + [(1000 + i, doc(0.5), "en", "noisy") for i in range(200)]
    data += [(5000, doc(0.5), "en", "clean"), (5001, doc(0.5), "en", "noisy"), (5002, None, "en", "noisy")]
    kept = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string")).collect()}
    assert not kept[5000] and kept[5001] and not kept[5002]
    assert sum(kept[i] for i in range(200)) == 200 and sum(kept[1000 + i] for i in range(200)) >= 198


def test_quantile_sketch_is_near(spark):
    from pyspark.sql import functions as F
    random.seed(8)
    values = sorted(random.expovariate(1) for _ in range(2000))
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(7)
    df = df.select(F.lit("").alias("lang"), F.lit("").alias("source"), F.lit(False).alias("base_failed"), *[F.col("v").alias(m) for m in quality.RATIOS])
    for r in quality.quantiles(quality.sketches(df)).collect():
        assert abs(r.q25 / values[499] - 1) <= 0.011 and abs(r.q75 / values[1499] - 1) <= 0.011 and r.rows == 2000


def test_native_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert secrets.scan(docs).collect() == [] and quality.judge(docs).collect() == []


def test_digest_of_no_spans(spark):
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
