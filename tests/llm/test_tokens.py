"""Operators 1 and 5 against the tokenizers library and plain Python."""

import random
import zlib

import numpy as np
import pytest

from acreage.llm import packing, token_files
from acreage.llm.token_path import BYTE_BPE, PIECES_32K
from acreage.llm.tokens import Encoder, encoder

SCHEMA = "doc_id bigint, text string, length string, offset int"
ALPHABET = [" ", "  ", "\n", "\n ", "'s", "'ll", "'", "a", "Zz", "é", " ", "1", "23", "!", "--", "\t", "中文", "\r\n", "ß", "\x1c", "\x85", "<|endoftext|>", "'S", "́", "　"]


def plain_encode(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(BYTE_BPE)
    t.encode_special_tokens = True
    return [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def fixture_rows():
    random.seed(5)
    word = ["alpha", "beta", "gamma,", "Delta.", "l'eau", "don't", "42", "\n"]
    rows = [(i, " ".join(random.choice(word) for _ in range(random.choice([1, 3, 40, 400, 900, 3000]))), "x", i) for i in range(60)]
    return rows + [(100, None, None, None), (101, "", "", 1), (102, rows[0][1], "a", 2), (None, "no key", "a", 3), (103, "a" * 30000, "", 0)]


def test_encoder_equals_library():
    random.seed(1)
    texts = ["".join(random.choice(ALPHABET) for _ in range(random.randint(0, 40))) for _ in range(3000)]
    got = [x.tolist() for x in Encoder(BYTE_BPE).encode(t.encode() for t in texts)]
    assert got == plain_encode(texts)


def test_encoder_long_text_and_forgetting():
    random.seed(2)
    long = "".join(random.choice(ALPHABET) for _ in range(900_000))
    few = Encoder(BYTE_BPE, most_known=50)
    texts = [long[:5000], long[5000:9000], "", long[9000:]]
    assert [x.tolist() for x in few.encode(t.encode() for t in texts)] == plain_encode(texts)


def loaded_encode(texts):
    """The contract's call: the tokenizer as loaded."""
    from tokenizers import Tokenizer
    return [x.ids for x in Tokenizer.from_file(BYTE_BPE).encode_batch(texts, add_special_tokens=False)]


def test_added_tokens_as_the_library_loads_them():
    random.seed(4)
    parts = ALPHABET + ["<|endoftext|>"] * 6 + ["<|endof", "text|>", "<|", "|>", "<"]
    texts = ["one <|endoftext|> two", "<|endoftext|>", "a<|endoftext|>", "x<|endof", "text|>y", "<|endoftext|><|endoftext|> "]
    texts += ["".join(random.choice(parts) for _ in range(random.randint(0, 40))) for _ in range(3000)]
    assert loaded_encode(texts[:1]) == [[505, 220, 50256, 734]]
    assert [x.tolist() for x in encoder(BYTE_BPE).encode(t.encode() for t in texts)] == loaded_encode(texts)
    long = "".join(random.choice(parts) for _ in range(500_000))
    few = Encoder(BYTE_BPE, most_known=50, as_text=False)
    assert [x.tolist() for x in few.encode([long.encode(), b"", b"a"])] == loaded_encode([long, "", "a"])


def test_added_tokens_in_the_operators(spark):
    rows = [(1, "one <|endoftext|> two", "", 0), (2, "three", "", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    ids = [x + [2] for x in loaded_encode([r[1] for r in rows])]
    files = token_files.read(token_files.write(docs, BYTE_BPE, end_id=2)).orderBy("start").collect()
    assert [(r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in files] == [(0, ids[0]), (len(ids[0]), ids[1])]
    pieces = packing.pieces(docs, BYTE_BPE, end_id=2).orderBy("doc_id").collect()
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in pieces] == ids


def check_packing(rows, packed, capacity, end_id):
    ids = {}
    for (doc, *_), x in zip(rows, plain_encode([r[1] or "" for r in rows])):
        ids.setdefault(doc, []).append(x + [end_id])
    seen, places = {}, {}
    for r in packed:
        mine = next(x for x in ids[r.doc_id] if zlib.crc32(np.array(x[r.start:r.start + r.length], dtype="<u4").tobytes()) == r.ids_crc32)
        seen.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, len(mine)))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc, parts in seen.items():
        parts.sort()
        assert [p[0] for p in parts] == list(range(len(parts)))
        at = 0
        for i, (_, start, length, total) in enumerate(parts):
            assert start == at and (i == 0 or length == capacity)
            at += length
        assert at == parts[0][3] and (len(parts) > 1) == (at > capacity)
    assert set(seen) == set(ids)
    for xs in places.values():
        at = 0
        for offset, length in sorted(xs):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


@pytest.mark.parametrize("capacity", [2048, 64])
def test_packing(spark, capacity):
    from pyspark.sql import functions as F
    rows = fixture_rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    p = packing.pieces(docs, BYTE_BPE, capacity=capacity).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    got = packing.pack(p, capacity).collect()
    n = check_packing(rows, got, capacity, 0)
    assert n <= np.ceil(sum(r.length for r in got) / capacity) * 1.25 + 1
    assert n == offline_best_fit([r.length for r in got], capacity)


def offline_best_fit(lengths, capacity):
    """One piece after the other, longest first, into the tightest gap."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        best = min((g for g in gaps if g >= n), default=None)
        if best is None:
            best = capacity
        else:
            gaps.remove(best)
        gaps.append(best - n)
    return len(gaps)


def test_plan_many_equal_lengths():
    random.seed(3)
    counts = {n: random.randint(1, 50) for n in range(1, 257)} | {100: 5000}
    by, first, seq, off = packing.plan(counts, 256)
    used = {}
    for n, c in counts.items():
        for r in range(c):
            i = np.flatnonzero((by == n) & (first <= r))[-1]
            used.setdefault(int(seq[i] + r - first[i]), []).append((int(off[i]), n))
    for xs in used.values():
        at = 0
        for o, n in sorted(xs):
            assert o == at
            at += n
        assert at <= 256


def test_packing_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert packing.pack(packing.pieces(docs, BYTE_BPE)).collect() == []


def test_token_files_round_trip(spark):
    rows = fixture_rows()
    manifest = token_files.write(spark.createDataFrame(rows, SCHEMA), BYTE_BPE, end_id=2)
    got = token_files.read(manifest).orderBy("start").collect()
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    ids = [x + [2] for x in plain_encode([r[1] or "" for r in rows])]
    start = 0
    for r, i in zip(got, order, strict=True):
        assert (r.doc_id, r.start, r.n_tokens) == (rows[i][0], start, len(ids[i]))
        assert np.frombuffer(r.ids, "<u4").tolist() == ids[i]
        start += len(ids[i])
    some = token_files.read(manifest, wanted=[3, 102, 999]).collect()
    assert sorted(r.doc_id for r in some) == [3, 102]


def test_token_file_is_public_format_and_checked(spark, tmp_path):
    import zstandard
    manifest = token_files.write(spark.createDataFrame([(1, "one two", "", 0), (2, "three", "", 0)], SCHEMA).coalesce(1), BYTE_BPE, folder=str(tmp_path / "f"))
    path = manifest.first().path
    raw = open(path, "rb").read()
    first = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    assert np.frombuffer(first, "<u4").tolist() == plain_encode(["one two"])[0] + [2]
    with open(path, "wb") as f:
        f.write(raw[:-30] + bytes([raw[-30] ^ 1]) + raw[-29:])
    with pytest.raises(Exception, match="damaged|checksum|table|rror"):
        token_files.read(manifest).collect()


def test_token_files_empty_table(spark):
    manifest = token_files.write(spark.createDataFrame([], SCHEMA), BYTE_BPE)
    assert token_files.read(manifest).count() == 0


def thue_morse(n):
    a, b = "ab", "ba"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_words_that_collide_in_sums_of_powers(spark):
    """Thue-Morse words and their complements have equal polynomial hashes modulo 2^64, whatever the odd factor."""
    import tokenizers

    from acreage.llm import jaccard
    from acreage.llm.token_counts import Counter, vocabulary
    from acreage.llm.tokens import Encoder
    a, b = thue_morse(9)
    e, t = a.replace("a", "e").replace("b", "t"), b.replace("a", "e").replace("b", "t")
    plain = tokenizers.Tokenizer.from_file(BYTE_BPE)
    for pair in ((a, b), (e, t)):
        got = list(Encoder(BYTE_BPE, as_text=False).encode([x.encode() for x in pair]))
        assert [g.tolist() for g in got] == [plain.encode(x, add_special_tokens=False).ids for x in pair]
        counts = [Counter(vocabulary(PIECES_32K)).of_texts([x.encode()])[0] for x in pair]
        assert Counter(vocabulary(PIECES_32K)).of_texts([x.encode() for x in pair]) == counts
    assert not set(jaccard.token_set(a.encode(), 5).tolist()) & set(jaccard.token_set(b.encode(), 5).tolist())


def test_equal_hashes_are_told_apart(monkeypatch):
    import numpy as np
    import tokenizers

    from acreage.llm import token_counts, tokens
    real = tokens.span_hashes
    for module in (tokens, token_counts):
        monkeypatch.setattr(module, "span_hashes", lambda d, s, e, seed=0: real(d, s, e, seed) if seed else np.zeros(len(s), dtype=np.uint64))
    texts = [b"one two three", b"two", b"one one"]
    plain = tokenizers.Tokenizer.from_file(BYTE_BPE)
    assert [x.tolist() for x in tokens.Encoder(BYTE_BPE, as_text=False).encode(texts)] == [plain.encode(t.decode(), add_special_tokens=False).ids for t in texts]
    c = token_counts.Counter(token_counts.vocabulary(PIECES_32K))
    assert c.of_texts(texts) == [sum(c.count(token_counts.MARK + w) for w in t.decode().split()) for t in texts]
