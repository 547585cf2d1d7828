"""Operator 11: periodic runs of words, by seeds on diagonals.

A run is a stretch of consecutive words with smallest period q, at least ``least_length``
words and ``least_repeats`` periods long, that no neighbouring word extends keeping q.
Words q apart match on a part of length - q words, the run's overlap on the diagonal of
lag q.  Periods are taken in bands [2^j, 2^(j+1)):

1. Index: k-grams of k = the least overlap that a run of the band can have.  Grams get exact
   names (equal names: equal words) by doubling: the name of 2m words is that of a pair of names
   of m words, that of k words the pair of two overlapping grams.  Grams that occur once in
   their document are dropped at each level, so ordinary text leaves the index early.
2. Seeds: each gram is paired with its next occurrence in the document only.  As k >= q - 1, the next
   occurrence of a gram in a run is exactly q words on (a nearer one would, by the theorem of
   Fine and Wilf, give the run a smaller period); so a seed for each run is found, no
   pairs of all occurrences are made, and no multiple of a smaller period is ever seeded.
3. Extension: seeds are taken by lag and place; a table of the furthest covered place of
   each lag drops the seeds in what is covered, the others are extended word by word.

Documents are independent: no shuffle.  Words are maximal runs of other bytes than
0x20 and 0x09-0x0D.

Defined results: null and empty texts have no word, no run and an empty collapsed text; equal rows
each give their row; texts of any length are treated whole (memory in proportion to the longest
one); runs are ordered by start, then period; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acreage.llm.common import small_batches, text_bytes

GROUP = 1 << 20                          # bytes of text that are searched at once
BLANKS = "[ \\t\\n\\u000B\\f\\r]+"
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense exact names of keys, and which keys occur more than once."""
    _, names, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return names, counts[names] > 1


class Grams:
    """Names of the grams of one length that occur more than once: ``at`` (ascending places), ``name`` by place."""

    def __init__(self, places: np.ndarray, names: np.ndarray, n: int, size: int) -> None:
        self.at, self.size = places, size
        self.name = np.full(n, -1, dtype=np.int64)
        self.name[places] = names

    def joined(self, shift: int) -> Grams:
        """Grams of size + shift words (shift <= size): pairs of names ``shift`` words apart."""
        at = self.at[self.at + shift < len(self.name)]
        at = at[self.name[at + shift] >= 0]
        names, twice = _repeated(self.name[at] * len(self.name) + self.name[at + shift])
        return Grams(at[twice], names[twice], len(self.name), self.size + shift)


def least_overlap(low: int, high: int, least_length: int, least_repeats: int) -> int:
    return min(max(least_length - q, (least_repeats - 1) * q) for q in range(low, min(high, low + least_length) + 1))


def _seeds(grams: Grams, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and lags of the grams whose next occurrence is ``low`` to ``high`` words on, by lag, then place."""
    order = np.argsort(grams.name[grams.at], kind="stable")
    place, name = grams.at[order], grams.name[grams.at][order]
    lag = np.diff(place)
    ok = (name[1:] == name[:-1]) & (lag >= low) & (lag <= high)
    place, lag = place[:-1][ok], lag[ok]
    order = np.lexsort((place, lag))
    return place[order], lag[order]


def _matching(words: np.ndarray, at: int, lag: int, step: int) -> int:
    """Number of places from ``at`` on (step 1) or before ``at`` (step -1) whose words are equal ``lag`` words apart."""
    found, width, n = 0, 32, len(words) - lag
    while True:
        a, b = (at + found, min(n, at + found + width)) if step > 0 else (max(0, at - found - width), at - found)
        if a >= b:
            return found
        same = words[a:b] == words[a + lag:b + lag]
        same = same if step > 0 else same[::-1]
        if not same.all():
            return found + int(np.argmin(same))
        found, width = found + b - a, width * 2


def find_runs(words: np.ndarray, least_length: int = 6, least_repeats: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of word numbers, by start and period.  Several
    documents may follow each other in ``words`` if no number occurs in two of them."""
    if least_repeats < 3:
        raise ValueError("at least three periods")
    names, twice = _repeated(words)
    level, runs, low = Grams(np.flatnonzero(twice), names[twice], len(words), 1), [], 1
    while len(level.at) and least_repeats * low <= len(words):
        high = 2 * low - 1
        k = least_overlap(low, high, least_length, least_repeats)
        while 2 * level.size <= k and len(level.at):
            level = level.joined(level.size)
        grams = level.joined(k - level.size) if k > level.size else level
        place, lag = _seeds(grams, low, high)
        heads = np.flatnonzero(np.r_[True, (np.diff(lag) != 0) | (np.diff(place) != 1)][:len(place)])
        tails = np.append(heads[1:], len(place))[:len(heads)] - 1
        covered: dict[int, int] = {}
        for q, first, last in zip(lag[heads].tolist(), place[heads].tolist(), place[tails].tolist()):
            if first < covered.get(q, 0):
                continue
            start = first - _matching(words, first, q, -1)
            end = last + k + _matching(words, last + k, q, 1)
            covered[q] = end
            if end - start + q >= max(least_length, least_repeats * q):
                runs.append((start, end - start + q, q))
        low *= 2
    return sorted(runs, key=lambda r: (r[0], r[2]))


def _grouped(texts, limit: int = GROUP):
    """Lists of the words of texts of together about ``limit`` bytes."""
    group, size = [], 0
    for t in texts:
        group.append(bytes(t).split())              # bytes.split() knows just these six blanks
        size += len(t)
        if size >= limit:
            yield group
            group, size = [], 0
    if group:
        yield group


def _numbered(group: list[list[bytes]]) -> np.ndarray:
    """Numbers of all words of a group of texts; equal words of one text, and only they, share a number."""
    out, base = [], 0
    for words in group:
        known: dict[bytes, int] = {}
        out.append(np.fromiter((known.setdefault(w, base + len(known)) for w in words), dtype=np.int64, count=len(words)))
        base += len(known)
    return np.concatenate(out)


def of_texts(texts, least_length: int = 6, least_repeats: int = 4):
    """(number of words, runs, collapsed text) of each text."""
    for group in _grouped(texts):
        ends = np.cumsum([len(w) for w in group])
        found = find_runs(_numbered(group), least_length, least_repeats)
        of_text: dict[int, list] = {}
        for i, r in zip(np.searchsorted(ends, [r[0] for r in found], side="right").tolist(), found):
            of_text.setdefault(i, []).append(r)
        for i, words in enumerate(group):
            base, n = int(ends[i]) - len(words), len(words)
            runs = [(s - base, length, q) for s, length, q in of_text.get(i, ())]
            if runs:
                step = np.zeros(n + 1, dtype=np.int64)
                for s, length, q in runs:
                    step[s + q] += 1
                    step[s + length] -= 1
                words = [words[j] for j in np.flatnonzero(np.cumsum(step[:n]) == 0).tolist()]
            yield n, runs, b" ".join(words)


def detect(docs: DataFrame, text: str = "text", key: str = "doc_id", least_length: int = 6, least_repeats: int = 4) -> DataFrame:
    """One row for each row of ``docs``: (doc_id, n_words, runs, collapsed).  ``collapsed`` holds the words that
    are in the first period of a run or in none, joined by one space."""
    kind = dict(docs.dtypes)[key]

    def search(batches):
        for batch in batches:
            rows = list(of_texts(text_bytes(batch.column(1)), least_length, least_repeats))
            offsets = np.cumsum([0] + [len(r) for _, r, _ in rows], dtype=np.int32)
            flat = np.array([x for _, r, _ in rows for x in r], dtype=np.int64).reshape(-1, 3)
            runs = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], names=["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _, _ in rows], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), runs),
                 pa.array([c for _, _, c in rows], pa.binary()).view(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    rows = small_batches(docs).select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(search, f"doc_id {kind}, n_words bigint, runs {RUNS}, collapsed string")


def greatest(runs: Column) -> Column:
    """The longest run (ties: smallest start, then period) as a struct; null if there is none."""
    best = F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    return F.when(best.isNotNull(), F.struct(best["start"].alias("start"), (-best["less"]).alias("length"), best["period"].alias("period")))


def listed(runs: Column) -> Column:
    """All runs as lines ``start,length,period``, each with its line feed."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")


def with_loop(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, text) where each document whose key's checksum h is divisible by 10 ends in a loop: of its n words,
    each word i >= a becomes word a + (i - a) % p, with g = h // 10, a = g % n, p = 1 + (n - a) // (3 + g % 8)."""
    h = F.crc32(F.col(key).cast("string"))
    words = F.filter(F.split(F.col(text), BLANKS), lambda w: w != "")
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.when(h % 10 == 0, words).alias("words"), F.floor(h / 10).alias("g"))
    rows = rows.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    looped = F.expr("array_join(transform(words, (w, i) -> if(i < a, w, get(words, a + (i - a) % p))), ' ')")
    return rows.select("doc_id", F.when(F.col("n") > 0, looped).otherwise(F.col("text")).alias("text"))
