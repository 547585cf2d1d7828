"""Operator 13: interaction of quality filters, from one pass over the bytes of each text.

Measures.  A transducer of two states (between words, in a word) walks the UTF-8 bytes.  A
table gives each byte its class (blank, capital, symbol, continuation of a code point, other), a
second table gives for (state, class) the actions: count a code point, a capital, a symbol, open a
word, close a word.  A word's span goes into a hash table; a slot's occupant is compared with the
word byte by byte, so the count of distinct words is exact whatever the hashes.  Both run over the
texts of an Arrow batch at once; texts above ``SEGMENT`` bytes go through in segments cut between words.

Filters.  A document's failures are a set of bits: few words, few distinct words, many capitals, a symbol,
an exact copy of a document of a smaller id (equal SHA-256; the smallest id by an aggregation
that combines before the shuffle, so a text of any number of copies is one row for each part).  Documents are
counted by (part, set of failures); all orders and steps are derived from these counts.

Defined results: null and empty texts have no word and no code point, so only the first filter (and the last, if an empty
document of a smaller id exists) removes them; null sources count as the empty string; a null id has no labels, is no copy, and nothing is a copy of
it; rows of the same id and text are no copies of each other; a document has a label if any of its label rows says so; an empty
table gives no rows; texts of any length are treated whole; other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acreage.llm.common import MULT, SEGMENT, cut_points, mix, small_batches, text_bytes

FILTERS = "ABCDE"
SYMBOLS = b"#$%&*|"
BLANK, CAPITAL, SYMBOL, TAIL, OTHER = range(5)               # classes of bytes
POINT, UPPER, SIGN, OPEN, CLOSE = 1, 2, 4, 8, 16             # actions
LONG = 64                                                    # longer words are compared as byte strings


def _classes() -> np.ndarray:
    t = np.full(256, OTHER, dtype=np.uint8)
    t[0x80:0xC0] = TAIL
    t[ord("A"):ord("Z") + 1] = CAPITAL
    t[list(SYMBOLS)] = SYMBOL
    t[[0x20, *range(0x09, 0x0E)]] = BLANK
    return t


def _actions() -> np.ndarray:
    """Actions of (state, class): row 0 between words, row 1 in a word."""
    t = np.zeros((2, 5), dtype=np.uint8)
    t[:, [BLANK, CAPITAL, SYMBOL, OTHER]] |= POINT
    t[:, CAPITAL] |= UPPER
    t[:, SYMBOL] |= SIGN
    t[0, [CAPITAL, SYMBOL, TAIL, OTHER]] |= OPEN
    t[1, BLANK] |= CLOSE
    return t


CLASS, ACTION = _classes(), _actions()
IS_WORD = CLASS != BLANK
KEEP = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)      # the first n bytes of eight


class Words:
    """Spans of a byte string, hashed and compared eight bytes at a time."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> None:
        self.raw = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
        self.eight = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=self.raw.data, strides=(1,))
        self.start, self.size, self.owner = starts, ends - starts, owner
        h = mix(owner.astype(np.uint64) * MULT + self.size.astype(np.uint64))
        pending = np.arange(len(starts))
        for at in range(0, LONG, 8):
            pending = pending[self.size[pending] > at]
            if not len(pending):
                break
            h[pending] = mix(h[pending] * MULT + self._part(pending, at))
        self.hash = h

    def _part(self, words: np.ndarray, at: int) -> np.ndarray:
        return self.eight[self.start[words] + at] & KEEP[np.minimum(8, self.size[words] - at)]

    def bytes(self, word: int) -> bytes:
        s = int(self.start[word])
        return self.raw[s:s + int(self.size[word])].tobytes()

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok = (self.owner[a] == self.owner[b]) & (self.size[a] == self.size[b])
        for at in range(0, LONG, 8):
            i = np.flatnonzero(ok & (self.size[a] > at) & (a != b))
            if not len(i):
                return ok
            ok[i] = self._part(a[i], at) == self._part(b[i], at)
        for i in np.flatnonzero(ok & (self.size[a] > LONG) & (a != b)):
            ok[i] = self.bytes(a[i]) == self.bytes(b[i])
        return ok

    def first(self) -> np.ndarray:
        """Which words are in the table for themselves: one of each set of equal words of an owner."""
        n = len(self.start)
        last = (1 << max(4, (2 * n).bit_length())) - 1
        table, slot = np.full(last + 1, -1, dtype=np.int64), (self.hash & np.uint64(last)).astype(np.int64)
        out, pending = np.zeros(n, dtype=bool), np.arange(n)
        while len(pending):
            free = pending[table[slot[pending]] < 0]
            table[slot[free[::-1]]] = free[::-1]            # of words that meet in a free slot the first stays
            there = table[slot[pending]]
            out[pending[there == pending]] = True
            pending = pending[~self.same(pending, there)]
            slot[pending] = (slot[pending] + 1) & last
        return out


def _pass(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Actions of each byte, and starts and ends of words; a text that begins at one of ``begins`` starts between words."""
    kind = CLASS[data]
    state = np.zeros(len(data), dtype=np.uint8)
    state[1:] = kind[:-1] != BLANK
    state[begins] = 0
    done = ACTION[state, kind]
    closed = np.zeros(len(data) + 1, dtype=bool)
    closed[:-1] = (done & CLOSE) > 0
    closed[begins] |= np.r_[False, kind[:-1] != BLANK][begins]        # a text's end closes its last word
    closed[-1] = kind[-1] != BLANK
    return done, np.flatnonzero(done & OPEN), np.flatnonzero(closed)


def _sums(done: np.ndarray, sizes: np.ndarray, action: int) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum((done & action) > 0)])
    ends = np.cumsum(sizes)
    return upto[ends] - upto[ends - sizes]


def _short(texts: list[bytes]) -> np.ndarray:
    """Words, distinct words, capitals, code points, symbols of each text."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    out = np.zeros((len(texts), 5), dtype=np.int64)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    if len(data):
        at = np.cumsum(sizes) - sizes
        done, starts, ends = _pass(data, at[sizes > 0])
        owner = np.searchsorted(np.cumsum(sizes), starts, side="right")
        words = Words(data, starts, ends, owner)
        out[:, 0] = np.bincount(owner, minlength=len(texts))
        out[:, 1] = np.bincount(owner[words.first()], minlength=len(texts))
        for c, action in ((2, UPPER), (3, POINT), (4, SIGN)):
            out[:, c] = _sums(done, sizes, action)
    return out


def _long(text: bytes) -> np.ndarray:
    """The same for one text, in segments cut between words; distinct words of segments meet in a set."""
    data, out, known = np.frombuffer(text, dtype=np.uint8), np.zeros(5, dtype=np.int64), set()
    cuts = cut_points(data, IS_WORD)
    for a, b in zip(cuts, cuts[1:]):
        done, starts, ends = _pass(data[a:b], np.array([0]))
        words = Words(data[a:b], starts, ends, np.zeros(len(starts), dtype=np.int64))
        known.update(words.bytes(i) for i in np.flatnonzero(words.first()))
        out += [len(starts), 0, *((done & action > 0).sum() for action in (UPPER, POINT, SIGN))]
    out[1] = len(known)
    return out


def of_texts(texts) -> np.ndarray:
    """A row for each text: words, distinct words, capitals, code points, symbols."""
    out, group, size = [np.zeros((0, 5), dtype=np.int64)], [], 0
    for t in itertools.chain(texts, [None]):
        if group and (t is None or size + len(t) > SEGMENT):
            out.append(_short(group))
            group, size = [], 0
        if t is None:
            break
        if len(t) > SEGMENT:
            out.append(_long(bytes(t))[None, :])
        else:
            group.append(bytes(t))
            size += len(t)
    return np.concatenate(out)


MEASURES = ["n_words", "n_distinct", "n_capitals", "n_points", "n_symbols"]


def measures(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """(doc_id, part, counts of ``MEASURES``, digest) of each document."""
    kind = dict(docs.dtypes)[key]

    def measure(batches):
        for batch in batches:
            texts = list(text_bytes(batch.column(2)))
            counts = of_texts(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(counts[:, c]) for c in range(5)],
                                              pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())], names=["doc_id", "part", *MEASURES, "digest"])

    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("part"), F.col(text).alias("text"))
    return small_batches(rows).mapInArrow(measure, f"doc_id {kind}, part string, {', '.join(f'{m} bigint' for m in MEASURES)}, digest binary")


def failures(rows: DataFrame, least_words: int = 200, distinct_pct: int = 50, capital_pct: int = 2) -> DataFrame:
    """Adds ``mask``: the bits of the first four filters."""
    fails = [F.col("n_words") < least_words, 100 * F.col("n_distinct") < distinct_pct * F.col("n_words"),
             100 * F.col("n_capitals") > capital_pct * F.col("n_points"), F.col("n_symbols") > 0]
    return rows.withColumn("mask", sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0)))


def counted(rows: DataFrame, labels: DataFrame, key: str = "doc_id", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each set of failures, the fifth filter included."""
    marks = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("doc_id")).agg(
        F.max((F.col(quality) == 1).cast("int")).alias("good"), F.max((F.col(toxic) == 1).cast("int")).alias("toxic"))
    rows = rows.select("doc_id", "part", "mask", "digest").join(marks, "doc_id", "left").fillna(0, ["good", "toxic"])
    sums = lambda *names: [F.sum(c).alias(c) for c in names]
    by_id = rows.groupBy("doc_id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n"), *sums("good", "toxic"))
    # What the smallest id of each (text, part) holds is kept beside the sums, so that it can be taken out of the copies.
    here = F.struct("doc_id", "n", "good", "toxic")
    known = F.col("doc_id").isNotNull()
    texts = by_id.groupBy("digest", "part", "mask").agg(
        *sums("n", "good", "toxic"), F.min(F.when(known, here)).alias("first"),
        *[F.sum(F.when(~known, F.col(c)).otherwise(0)).alias(f"no_id_{c}") for c in ("n", "good", "toxic")])
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))               # a row for each part of a text
    texts = texts.withColumn("leads", F.coalesce(F.col("first.doc_id") == least, F.lit(False)))
    kept = [(F.col(f"no_id_{c}") + F.when(F.col("leads"), F.col(f"first.{c}")).otherwise(0)).alias(c) for c in ("n", "good", "toxic")]
    gone = [(F.col(c) - F.col(f"no_id_{c}") - F.when(F.col("leads"), F.col(f"first.{c}")).otherwise(0)).alias(c) for c in ("n", "good", "toxic")]
    both = F.array(F.struct(F.col("mask"), *kept), F.struct((F.col("mask") + 16).alias("mask"), *gone))
    return texts.select("part", F.inline(both)).groupBy("part", "mask").agg(*sums("n", "good", "toxic"))


def orders() -> list[dict]:
    """All steps of all orders of the filters: the bit of the step's filter and those of the filters before it."""
    out = []
    for order in itertools.permutations(range(len(FILTERS))):
        for step, f in enumerate(order):
            out.append({"filter_order": "".join(FILTERS[i] for i in order), "step": step + 1, "bit": 1 << f, "before": sum(1 << i for i in order[:step])})
    return out


def interactions(docs: DataFrame, labels: DataFrame, **names: str) -> DataFrame:
    """One row for each part, order of filters and step; counts of documents of the part."""
    sets = counted(failures(measures(docs, **names)), labels)
    parts = sets.where("n > 0").groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("sets"))      # 32 sets at most
    steps = F.from_json(F.lit(json.dumps(orders())), "array<struct<filter_order: string, step: int, bit: int, before: int>>")
    rows = parts.select("part", "sets", F.inline(steps))

    def total(what: str, where: str) -> F.Column:
        return F.expr(f"aggregate(filter(sets, s -> {where}), 0L, (a, s) -> a + {what})")

    here = "(s.mask & (before | bit)) = bit"
    return rows.select(
        "part", "filter_order", "step", total("s.n", "(s.mask & (before | bit)) = 0").alias("kept"), total("s.n", here).alias("removed"),
        total("s.n", "(s.mask & bit) > 0 and (s.mask & before) > 0").alias("redundant"), total("s.n", "s.mask = bit").alias("unique_fails"),
        total("s.good", here).alias("good_lost"), total("s.toxic", here).alias("toxic_lost"),
        # of the 120 orders, a document's k failing filters are first among themselves equally often
        total("s.n * (120 div bit_count(s.mask))", "(s.mask & bit) > 0").alias("shapley"))
