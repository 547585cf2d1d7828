"""Operators 2 and 10, the registered queries and the pipeline."""

import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
sys.path.insert(0, os.path.dirname(__file__))
import plain  # noqa: E402

import corpus_pipeline  # noqa: E402
from acreage.llm import language, token_counts  # noqa: E402
from acreage.llm.queries import ORACLE, QUERIES  # noqa: E402
from acreage.llm.token_path import PIECES_32K  # noqa: E402

SF = "/root/testdata/sf0.001"
WORDS = {"en": "the and of to in that with which from have".split(), "de": "der und die nicht auch über schön durch eine größe".split(),
         "fr": "le la été dans très être avec pour français une".split()}


def corpus(n=300, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        rows.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.choice([8, 40, 300]))), lang, "s", 1))
    return rows


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_language_is_learned_and_edge_cases(spark):
    rows = corpus()
    edge = [(1000, None, "en", "s", 0), (1001, "", "en", "s", 0), (1002, "12 !! 34", "en", "s", 0), (None, "der und die schön", None, "s", 0),
            (1003, "The Of And " * 80_000, None, "s", 0), rows[0], rows[0], (1004, "İİ der und die nicht", None, "s", 0)]
    docs = spark.createDataFrame(rows + edge, DOCS)
    model = language.train(docs)
    got = language.predict(docs, model).collect()
    held = [r for r in got if r.doc_id is not None and r.doc_id < 1000]
    assert np.mean([r._lang.pred == r.lang for r in held]) > 0.99
    by = {r.doc_id: r._lang for r in got}
    for k in (1000, 1001, 1002):
        assert (by[k].pred, by[k].score, by[k].rejected) == ("und", 0.0, True)
    assert by[None].pred == "de" and by[1003].pred == "en" and by[1004].pred == "de"
    assert all(0 <= r._lang.score <= 1 for r in got) and len(got) == len(rows) + len(edge)
    assert {r.doc_id for r in language.keep(docs).collect()} >= {r[0] for r in rows} and language.keep(docs).columns == docs.columns


def test_language_not_learned_from_held_out_rows(spark):
    import zlib
    rows = [(i, " ".join(WORDS["fr" if zlib.crc32(str(i).encode()) % 4 == 2 else "en"]), "x" if zlib.crc32(str(i).encode()) % 4 == 2 else "en", "s", 1) for i in range(200)]
    assert language.train(spark.createDataFrame(rows, DOCS)).langs == ["en"]


def test_language_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    model = language.train(docs)
    assert language.predict(docs, model).collect() == []
    one = spark.createDataFrame([(1, "text", None, "s", 1)], DOCS)
    assert language.predict(one, model).first()._lang.pred == "und"


def test_language_prediction_of_parts_equals_whole():
    rng = random.Random(2)
    text = " ".join(rng.choice(sum(WORDS.values(), [])) for _ in range(200_000))
    model = language.Model(["a", "b"], np.random.default_rng(1).normal(size=(1 << language.LOG2_BUCKETS, 2)), np.zeros(2))
    b, n = language.features(text)
    want = (n[:, None] * model.scores[b]).sum(axis=0) / n.sum()
    assert np.allclose(language.logits(model, ["x y", text, "z"])[1], want)


def unigram():
    from tokenizers import Tokenizer, models, pre_tokenizers
    vocab = token_counts.vocabulary(PIECES_32K)
    t = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always")
    return vocab, t


def test_token_counts_equal_library(spark):
    rng = random.Random(3)
    bits = [" ", "  ", "\n", "a", "ab", "the", "ing", "é", "中", "😀", "▁", "<s>", "<0x41>", "\t", "zq", "<unk>"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(1500)] + ["the " * 400_000, "x" * 5000, " ", "  "]
    vocab, t = unigram()
    want = [len(x.ids) for x in t.encode_batch(texts, add_special_tokens=False)]
    assert token_counts.Counter(vocab).of_texts(x.encode() for x in texts) == want
    assert token_counts.Counter(vocab, most_known=20).of_texts(x.encode() for x in texts[:300]) == want[:300]
    rows = [(i, x, "c") for i, x in enumerate(texts[:200])] + [(900, None, "c"), (None, "the", "c"), (3, texts[3], "c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")
    got = sorted(map(tuple, token_counts.count_tokens(docs, PIECES_32K).collect()), key=str)
    assert got == sorted([(i, n) for i, n in enumerate(want[:200])] + [(900, 0), (None, 1), (3, want[3])], key=str)
    assert token_counts.count_tokens(docs.limit(0), PIECES_32K).collect() == []


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, name):
    from acreage.plans.check import digest, duck
    assert digest(QUERIES[name](spark, SF).toPandas()) == digest(duck(SF).execute(ORACLE[name]).df())


def test_pipeline_stages_against_plain_python(spark):
    """Each stage but the first (a trained model) against a plain version of it, on its own input."""
    from acreage.llm.common import table
    docs = table(spark, SF, "documents")
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, SF)
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        seen[name] = len(rows)
        texts = {r.doc_id: r.text for r in before}
        if name != "pack":
            assert docs.columns == columns
        if name == "language":
            assert len(rows) >= 0.98 * len(before)
        elif name == "lines":
            want = plain.without_boilerplate([(r.text, r.source) for r in before], 10)
            want = {r.doc_id: t for r, (_, gone, t) in zip(before, want) if not gone or t.strip()}
            assert {r.doc_id: r.text for r in rows} == want
            assert all(r.n_chars == len(r.text) for r in rows)
        elif name == "near_duplicates":
            want = plain.jaccard_components([(r.doc_id, r.text) for r in before])
            assert {r.doc_id for r in rows} == {k for k, n, c in want if not n or k == c}
        elif name == "decontaminate":
            assert {r.doc_id for r in rows} == {k for k, _, hit, _ in plain.benchmark_hits(list(texts.items()), items) if not hit}
        elif name == "pack":
            assert {r.doc_id for r in rows} == set(texts)
            used = {}
            for r in rows:
                assert len(r.ids) == 4 * r.length
                used.setdefault(r.sequence_id, []).append((r.offset, r.length))
            for x in used.values():
                assert sum(n for _, n in x) <= corpus_pipeline.CAPACITY and [o for o, _ in sorted(x)] == [sum(n for o, n in x if o < p) for p, _ in sorted(x)]
    assert seen["near_duplicates"] < seen["lines"] and seen["decontaminate"] < seen["near_duplicates"]


def test_pipeline_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_pipeline_nulls_and_repeated_rows(spark):
    rows = corpus(60) + [(100, None, None, None, None), (101, "", "en", "s", 0), (None, "the and of to in that", "en", None, 1), corpus(60)[0], corpus(60)[0]]
    docs = spark.createDataFrame(rows, DOCS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    got = [r.doc_id for r in docs.where("piece = 0").collect()]
    assert len(got) == len(set(got)) and 100 not in got
