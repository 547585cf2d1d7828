"""Extra columns whose names an operator uses for itself."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

from acreage.llm import decontaminate, language, lines, packing, repeats  # noqa: E402

LINES = "a line of twelve sites\nits own words number "
TEXT = "the quick brown fox jumps over the lazy dog and runs into the deep wood"


def docs(spark, *extra):
    rows = [(i, f"s{i}", "en" if i % 2 else "de", LINES + f"{i} {i * 7} {TEXT if i % 2 else 'der alte mann und das weite meer am abend'}") for i in range(12)]
    rows += [(12, None, None, None), (13, "s1", "en", "")]
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").selectExpr("*", *[f"doc_id + 1000 as `{n}`" for n in extra])


def same_without(spark, run, extra, replaced=()):
    """The result with the extra columns is the one without them, and they pass through."""
    plain, wide = run(docs(spark)), run(docs(spark, *extra))
    passed = [n for n in extra if n not in replaced]
    assert [c for c in wide.columns if c not in passed] == plain.columns
    assert sorted(map(repr, wide.drop(*passed).collect())) == sorted(map(repr, plain.collect()))
    rows = wide.collect()
    assert rows and all(r[n] == r["doc_id"] + 1000 for r in rows for n in passed)


def test_lines(spark):
    extra = ("_found", "_FOUND_", "_lines", "_gone", "line", "version", "bad")
    same_without(spark, lambda d: lines.remove(d, least_sites=10), extra, replaced=("_lines",))


def test_language(spark):
    same_without(spark, lambda d: language.keep(d), ("_lang", "row"))


def test_decontamination(spark):
    items = spark.createDataFrame([("q", TEXT)], "item_id string, text string")
    same_without(spark, lambda d: decontaminate.drop_hit(d, items), ("_hit", "_row", "_text", "row", "words"))


def test_repeats(spark):
    same_without(spark, lambda d: repeats.remove(d, length=64), ("_id", "_hash", "_text", "_spans", "_kept", "start"), replaced=("_spans", "_kept"))


def test_packing(spark):
    def run(d):
        items = d.selectExpr("*", "length(coalesce(text, '')) + 1 as length", "0 as piece")
        return packing.pack(items, capacity=256).drop("source", "lang")
    same_without(spark, run, ("_part", "_rank", "sequence_id", "offset", "n", "c", "p"), replaced=("sequence_id", "offset"))


def test_pipeline_lines_stage(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    d = docs(spark, "_lines", "_found").selectExpr("*", "length(text) as n_chars")
    out = corpus_pipeline.lines_stage(spark, d, None)
    assert out.columns == d.columns
    assert all(r["_lines"] == r["doc_id"] + 1000 for r in out.collect())
