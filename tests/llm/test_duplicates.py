"""Operators 3, 6, 8 and 9 against plain Python."""

import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import plain  # noqa: E402

from acreage.llm import components, decontaminate, jaccard, lines, queries, repeats  # noqa: E402
from acreage.session import ensure_checkpoint_dir  # noqa: E402

SCHEMA = "doc_id bigint, text string, source string, n string, root int, tokens string, _doc int"


def words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def near_copies(rng, base, edits):
    out = list(base)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return out


def documents(seed=3):
    """Copies, chains of near copies, a hub with many near copies, common passages, edge cases."""
    rng = random.Random(seed)
    passage, texts = words(rng, 40), []
    for _ in range(25):
        texts.append(words(rng, rng.choice([3, 5, 6, 40, 200])))
    for _ in range(12):
        base = words(rng, rng.choice([30, 120, 300]))
        texts += [near_copies(rng, base, k) for k in (0, 1, 1, 2, 3, 5)]
    chain = words(rng, 200)
    for _ in range(8):
        texts.append(chain)
        chain = near_copies(rng, chain, 2)
    hub = words(rng, 150)
    texts += [near_copies(rng, hub, rng.choice([1, 2, 3])) for _ in range(60)]
    texts += [hub] * 20
    texts += [words(rng, 60) + passage + words(rng, rng.choice([5, 60])) for _ in range(30)]
    out = [" ".join(t) for t in texts] + ["", None, None, "One two", "one TWO", " \n\t", "one", "a b c d e", "A B C D E", "x " * 3000, "x " * 3010]
    rng.shuffle(out)
    rows = [(i * 3 + 1, t) for i, t in enumerate(out)]
    return [*rows, rows[0], rows[0], (rows[5][0], rows[6][1]), (None, "a key is missing here"), (None, rows[7][1])]


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "s", "n", 1, "t", 2) for k, t in rows], SCHEMA).repartition(6)


@pytest.mark.parametrize("seed", [3, 4])
def test_jaccard_components(spark, seed):
    rows = documents(seed)
    got = sorted(map(tuple, jaccard.similar(frame(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == sorted(plain.jaccard_components(rows), key=str)


def test_keep_one_with_clashing_names_and_repeated_rows(spark):
    text = "one two three four five six seven eight"
    rows = [(1, text), (2, text), (2, text), (3, "another text of its own with words"), (3, "another text of its own with words"), (4, ""), (4, ""), (5, None), (None, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "*", *[f"1 as {n}" for n in ("_drop", "_empty", "_id", "_copy", "row", "text_id", "touched", "one", "n_shingles")])
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted(
        [(None, text), (3, rows[3][1]), (4, ""), (4, ""), (5, None)], key=repr)


def test_jaccard_keep_one(spark):
    rows = documents()
    want = plain.jaccard_components(rows)
    kept = jaccard.keep_one(frame(spark, rows)).collect()
    empty = sum(1 for _, n, _ in want if n == 0)
    # a component is named by its least key; the rows without a key that link to nothing are one each
    assert len(kept) == empty + len({c for k, n, c in want if n and c is not None}) + sum(1 for k, n, c in want if n and c is None)
    assert kept[0].asDict().keys() == {"doc_id", "text", "source", "n", "root", "tokens", "_doc"}


def test_jaccard_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert jaccard.similar(empty).collect() == [] and jaccard.keep_one(empty).collect() == []


def test_components_of_paths_and_stars(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(100, 180)] + [(500, x) for x in range(501, 560)] + [(900, 901), (901, 900), (902, 902)]
    rng.shuffle(pairs)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {i: 100 for i in range(100, 181)} | {i: 500 for i in range(500, 560)} | {900: 900, 901: 900}


def test_decontamination(spark):
    rng = random.Random(6)
    items = [(i, " ".join(words(rng, rng.choice([1, 2, 4, 5, 7, 9, 10, 11, 30]), 300))) for i in range(40)]
    items += [(100, items[3][1]), (101, None), (102, " ,;! "), (103, items[30][1].upper()), (None, items[8][1])]
    docs = []
    for i in range(80):
        parts = words(rng, rng.choice([0, 3, 30, 100]), 3000)
        for _ in range(rng.choice([0, 0, 1, 3])):
            w = rng.choice([t for _, t in items if t]).split()
            a = rng.randrange(max(1, len(w) - 9))
            parts += [*w[a:a + rng.choice([9, 10, 12, 40])], "éa"]
        docs.append((i, "; ".join(parts).title()))
    docs += [(200, None), (201, ""), (202, items[20][1]), docs[5], docs[5], (None, items[21][1])]
    table = spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id bigint, text string, words int").repartition(4)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, [x for x in r["items"]]) for r in decontaminate.report(table, bench).collect()), key=str)
    want = [(k, n, hit, [x for x in names if x != "None"]) for k, n, hit, names in plain.benchmark_hits(docs, items)]
    assert got == sorted(want, key=str)
    kept = decontaminate.drop_hit(table, bench)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(k) for k, _, hit, _ in want if not hit) and kept.columns == table.columns


def test_decontamination_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    r = decontaminate.report(docs, none).first()
    assert (r.n_words, r.n_hit, r["items"]) == (3, 0, [])
    assert decontaminate.report(docs.limit(0), spark.createDataFrame([(1, "a b")], "item_id bigint, text string")).collect() == []
    assert decontaminate.drop_hit(docs, none).count() == 1


def test_line_dedup(spark):
    rng = random.Random(9)
    common = [f"boilerplate {i}" for i in range(30)]
    rows = []
    for i in range(300):
        parts = [rng.choice(common[:rng.choice([2, 30])]) if rng.random() < 0.4 else " ".join(words(rng, 4)) for _ in range(rng.choice([1, 4, 12]))]
        rows.append((i, "\n".join(x + rng.choice(["", " ", "\t"]) for x in parts) + rng.choice(["", "\n\n"]), rng.choice([None, *[f"s{k}" for k in range(14)]])))
    rows += [(900, None, "s1"), (901, "", "s1"), (902, "\n \n", None), rows[3], rows[3], (None, rows[4][1], "s2"), (rows[5][0], rows[6][1], rows[6][2])]
    table = spark.createDataFrame([(k, t, s, "x", 1) for k, t, s in rows], "doc_id bigint, text string, source string, line string, gone int").repartition(5)
    got = sorted(((r.doc_id, r._lines.total, r._lines.removed, r.text, r.line, r.gone) for r in lines.remove(table, least_sites=10).collect()), key=str)
    want = [(k, n, gone, text, "x", 1) for (k, _, _), (n, gone, text) in zip(rows, plain.without_boilerplate([(t, s) for _, t, s in rows], 10))]
    assert got == sorted(want, key=str)
    assert lines.remove(table.limit(0)).collect() == []


def test_line_sketch_far_and_near(spark):
    data = [(h, f"site{i}") for h, n in ((1, 1000), (2, 300), (3, 110), (4, 99), (5, 100), (6, 5)) for i in range(n)]
    got = lines.boilerplate(spark.createDataFrame(data, "line bigint, site string").repartition(5), least_sites=100)
    assert sorted(r.line for r in got.collect()) == [1, 2, 3, 5]


def repeat_rows(seed=1):
    rng = random.Random(seed)
    letters = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passages = [letters(rng.choice([60, 90, 150, 400])) for _ in range(8)]
    texts = []
    for _ in range(80):
        parts = [letters(rng.choice([5, 50, 200]))]
        for _ in range(rng.choice([0, 1, 2])):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            parts += [p[a:a + rng.choice([30, 63, 64, 65, 100, 500])], letters(20)]
        texts.append("".join(parts))
    texts += ["a" * 700, "ab" * 200, "", None, texts[0], texts[0] + "x", "y" + texts[0], texts[3] + texts[3]]
    return [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (5, texts[9]), (None, texts[2])]


@pytest.mark.parametrize("most", [1000, 2])
def test_repeats(spark, most):
    rows = repeat_rows()
    table = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id bigint, text string, start int").repartition(5)
    got = sorted(((r.doc_id, len(r.text.encode()) - len(r._kept) if r.text else 0, len(r._spans), bytes(r._kept)) for r in repeats.remove(table, length=64, most=most).collect()), key=str)
    want = [(k, *x) for (k, _), x in zip(rows, plain.without_repeats([t for _, t in rows], 64))]
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("block", [100, 300, 1000])
def test_anchors_of_blocks_name_each_place_once(monkeypatch, block):
    rng = random.Random(11)
    monkeypatch.setattr(repeats, "BLOCK", block)
    for n in (63, 64, 299, 300, 700, 5000):
        text = rng.randbytes(n)
        grams = np.arange(max(0, n - repeats.GRAM + 1))
        h = repeats.range_hash(repeats.prefix_hash(np.frombuffer(text, dtype=np.uint8)), grams, grams + repeats.GRAM)
        content = {}
        for a in range(n - 64 + 1):
            span = range(a, a + 64 - repeats.GRAM + 1)
            content[min(span, key=lambda p: h[p])] = True
        found = [np.concatenate(x) for x in zip(*repeats.anchors(text, 64))] or [np.zeros(0, dtype=np.int64)] * 5
        assert sorted(found[0].tolist()) == sorted(content)
        assert len(np.unique(found[2])) == len(found[2])          # contexts of a text without repeats occur once


def test_repeats_unique_text_of_several_blocks(spark):
    rng = random.Random(12)
    letters = bytes(rng.choices(range(97, 123), k=(7 * repeats.BLOCK) // 2)).decode()
    twice = letters[repeats.BLOCK - 300:repeats.BLOCK + 200]       # stands over a border of blocks
    rows = [(1, letters), (2, letters[::-1]), (3, "x" + twice + "y")]
    table = spark.createDataFrame(rows[:2], "doc_id bigint, text string")
    assert [(r.doc_id, r._spans, bytes(r._kept).decode()) for r in repeats.remove(table).orderBy("doc_id").collect()] == [(k, [], t) for k, t in rows[:2]]
    got = {r.doc_id: bytes(r._kept).decode() for r in repeats.remove(spark.createDataFrame(rows, table.schema)).collect()}
    assert got == {1: letters.replace(twice, ""), 2: letters[::-1], 3: "xy"}


def test_repeats_small_tables(spark):
    table = spark.createDataFrame([(1, "short"), (2, None)], "doc_id bigint, text string")
    assert sorted(bytes(r._kept) for r in repeats.remove(table).collect()) == [b"", b"short"]
    assert repeats.remove(table.limit(0)).collect() == []


def words_of(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 10))) for _ in range(n))


def test_repeats_shared_passages_below_half_the_length_are_not_indexed(spark, monkeypatch):
    rng, real, rows = random.Random(21), repeats.stored, {}
    line = words_of(rng, 60)[:150]
    data = [(i, f"{words_of(rng, 120)} {line} {words_of(rng, 120)}") for i in range(40)]

    def stored(df, name):
        rows[name] = real(df, name)
        return rows[name]
    monkeypatch.setattr(repeats, "stored", stored)
    monkeypatch.setattr(repeats, "discard", lambda *frames: None)
    got = repeats.remove(spark.createDataFrame(data, "doc_id bigint, text string"))
    assert rows["open"].count() == 0
    assert [r._spans for r in got.collect()] == [[]] * 40


@pytest.mark.parametrize("most", [1000, 2])
def test_repeats_delete_the_tables_that_nothing_reads(spark, most):
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    table = spark.createDataFrame(repeat_rows(seed=4), "doc_id bigint, text string")
    before = set(os.listdir(folder))
    assert repeats.remove(table, length=64, most=most).count() == table.count()
    assert [n.split("-")[0] for n in set(os.listdir(folder)) - before] == ["spans"]


def test_query_tells_documents_with_a_repeat(spark, tmp_path):
    rng = random.Random(22)
    passages = [words_of(rng, n) for n in (51, 55, 60, 80, 110, 150)]           # of over 50 words; 400 bytes decide
    texts = [f"{words_of(rng, 90)} {p} {words_of(rng, 90)}" for p in passages for _ in range(2)] + [words_of(rng, 200) for _ in range(6)] + ["short", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.QUERIES["op9_repeated_strings"](spark, str(tmp_path)).collect()}
    want = plain.without_repeats(texts, 400)
    assert {k: (r.n_removed, r.n_spans) for k, r in got.items()} == {k: (x[0], x[1]) for k, x in enumerate(want)}
    assert {k for k, r in got.items() if r.has_repeat} == {k for k, x in enumerate(want) if x[0]}
    assert {k for k, r in got.items() if r.has_repeat} == {2 * i + j for i, p in enumerate(passages) if len(f" {p} ") >= 400 for j in (0, 1)} != set()


def test_run_index_matches():
    rng = random.Random(5)
    for _ in range(60):
        segments = [bytes(rng.choice(b"ab\x00") for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(1, 7))]
        index = repeats.RunIndex(segments)
        got = index.matching().tolist()
        places = [(s, a) for s, x in enumerate(segments) for a in range(len(x))]
        for s, a in places:
            best = 0
            for t, b in places:
                if (s, a) != (t, b):
                    n = 0
                    while a + n < len(segments[s]) and b + n < len(segments[t]) and segments[s][a + n] == segments[t][b + n]:
                        n += 1
                    best = max(best, n)
            assert got[int(index.starts[s]) + a] == best
        assert len(index.runs) == len(index.run_at) <= index.n
