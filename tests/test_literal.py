"""Python literals against Python's own reader, on a generated corpus and on texts that are none."""

import ast
import json
import random

from acreage.functions import parse as P
from acreage.functions.literal import is_bad_literal, to_json_text

TEXTS = ["Gym", "Kid's Area", 'say "hi"', "", "back\\slash", "line\nbreak", "tab\t", "ünï ₹ \U0001f3e0", "a, [b] {c}: (d)", "None", "\x07\x1f", "it's", "'", '"""']


def plain(v):
    """The value as JSON knows it: lists for tuples, texts for keys."""
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, dict):
        return {str(k): plain(x) for k, x in v.items()}
    return v


def value(rng, depth):
    kind = rng.randrange(9 if depth else 5)
    if kind == 0:
        return rng.choice([None, True, False])
    if kind == 1:
        return rng.choice([0, -3, 12_500, 1 << 40])
    if kind == 2:
        return rng.choice([0.5, -2.25, 1e20, 1e-7, 3.0])
    if kind <= 4:
        return "".join(rng.choice(TEXTS) for _ in range(rng.randrange(3)))
    if kind <= 6:
        return [value(rng, depth - 1) for _ in range(rng.randrange(4))]
    if kind == 7:
        return tuple(value(rng, depth - 1) for _ in range(rng.randrange(4)))
    return {rng.choice([*TEXTS, 1, 2.5, None, True]): value(rng, depth - 1) for _ in range(rng.randrange(4))}


GOOD = [r"'\x41é\U0001F600\101\a\v\b\f\r\q'", r"r'\d+\n'", r'R"a\"b"', "u'x'", "'a' 'b' \"c\"", "('one')", "(1)", "(1,)", "()", "[1, 2, ]", "{'a': (1, 2,), }",
        "'''it's\n'two' lines'''", '"""x"" y"""', "''", '""', "0xFF", "-0x1f", "0o17", "0b101", "1_000", "1.", ".5", "-.5e3", "+7", "- 7", "1.e2", "000", "00.5", "010.5", "1E+5",
        "[[], {}, [()]]", "{2: 'a', None: 2, True: [3]}", "'\\\nx'", "[None,True , False]", "'x' * 0"[:3], "[" * 30 + "]" * 30]
WRONG = ["junk[", "[1, 2", "(1]", "[1}", "{'a' 1}", "{'a': }", "[1 2]", "1 2", "[,]", "'abc", "\"abc'", "'a\nb'", "nan", "foo", "[1, foo()]", "12abc", "1__0", "1_", "007", r"'\x4'", r"'\u12'",
         "]", "'a'b", "--", "1+", "{'a': 1, 'b'}", "not True", "[1,,2]"]


def test_corpus_equals_the_python_reader(spark):
    rng = random.Random(11)
    texts = GOOD + [repr(value(rng, 4)) for _ in range(1500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, x string")
    for r in rows.select("x", to_json_text(rows.x).alias("j"), is_bad_literal("x").alias("bad")).collect():
        assert not r["bad"], r["x"]
        assert json.loads(r["j"]) == plain(ast.literal_eval(r["x"])), r["x"]


def test_texts_that_are_no_literal(spark):
    for text in WRONG:
        try:
            ast.literal_eval(text)
        except (ValueError, SyntaxError):
            continue
        raise AssertionError(text)
    rows = spark.createDataFrame([(t,) for t in WRONG], "x string")
    for r in rows.select("x", is_bad_literal("x").alias("bad"), P.decode_literal("x", "array<string>").alias("v")).collect():
        assert r["bad"] and r["v"] == [], r["x"]


def test_null_blank_and_very_long_texts(spark):
    long = "[" + ", ".join(f"'item {i} of \\'many\\''" for i in range(40_000)) + ", \"" + "x" * 300_000 + "\"]"
    rows = spark.createDataFrame([(0, None), (1, ""), (2, "  "), (3, "None"), (4, long)], "id int, x string")
    got = {r["id"]: r for r in rows.select("id", is_bad_literal("x").alias("bad"), P.decode_literal("x", "array<string>").alias("v")).collect()}
    assert [got[i]["bad"] for i in range(5)] == [False] * 5
    assert [got[i]["v"] for i in range(4)] == [[]] * 4
    assert got[4]["v"] == ast.literal_eval(long)
