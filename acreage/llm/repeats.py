"""Operator 9: removal of long repeated byte strings with a run-length index.

A string of ``length`` bytes is repeated if it starts at two places of the corpus, in one
document or two; every byte of a repeated string is removed.

1. Each window of ``length`` bytes has anchors: its substrings of half that length (``gram``)
   of least hash.  Equal windows have equal anchors at equal offsets, so repeats meet at anchors
   (one for about 100 bytes of 400).  The context of an anchor holds every window that has it.
2. Contexts are counted by (anchor, context), first inside a text, then over the corpus.
   An anchor that occurs once, or in repeated contexts alone, ends here.  A context that occurs
   twice or more is repeated as a whole, so copies and periodic texts cost no more.
3. The different contexts of an anchor that is left go to one task, with other anchors, about
   ``target`` bytes in all.  It merges overlapping spans of a text (so each byte of the corpus
   stands there once), sorts the suffixes, keeps the run-length Burrows-Wheeler transform with the
   suffixes at run starts and ends, and streams matching statistics from them: between
   two samples the match with the neighbouring suffix shrinks by one for each byte.
   Matches of ``length`` or more are marked.
4. Anchors of more than ``most`` different contexts would not fit one task.  The offsets that such
   an anchor can have in a window are cut into intervals.  All windows of an interval share the
   interval's core (the bytes common to them) and lie in its span (the bytes of any of them).
   A span that occurs twice is repeated, a core that occurs once rules its interval out; only the
   other spans go on as in step 3, by their cores.
5. Cores of more than ``most`` different spans would not fit one task either.  Their intervals are cut
   and counted once more.  Where that leaves more than ``most`` spans, windows are
   counted exactly, by a 64-bit hash of offset and content, as a distributed sum.

Defined results: null text counts as empty; texts shorter than ``length`` keep all bytes;
repeated rows repeat each other; a null key is kept; an empty table gives no rows; other
columns pass through ``remove``.  Stored tables are deleted once nothing reads them.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acreage.llm.common import MULT, bitmap, discard, in_bitmap, mix, prefix_hash, range_hash, small_batches, stored, text_bytes, unused

GRAM = 32                                  # at least
BLOCK = 1 << 20
LOG2_BITS = 27


def gram(length: int) -> int:
    """Bytes of an anchor.  The longer, the fewer anchors occur in different contexts; the shorter, the fewer anchors."""
    return max(GRAM, length // 2)


def sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """best (minimum or maximum) over every ``width`` consecutive values."""
    out, w = values, 1
    while 2 * w <= width:
        out = best(out[:-w], out[w:])
        w *= 2
    rest = width - w
    return best(out[:len(values) - width + 1], out[rest:rest + len(values) - width + 1])


def anchors(text, length: int):
    """(place, anchor hash, context hash, context start, context end) of the anchors of a text, each place once."""
    data = np.frombuffer(text, dtype=np.uint8)
    reach = length - gram(length)               # of an anchor's offset in a window
    seen = np.zeros(0, dtype=np.int64)          # places found that later blocks look at again
    for at in range(0, max(0, len(data) - length + 1), BLOCK):
        base = max(0, at - reach)
        part = data[base:at + BLOCK + 2 * length]
        prefix = prefix_hash(part)
        n = min(BLOCK, len(data) - length + 1 - at)               # windows that start in this block
        g = np.arange(at - base, at - base + n + reach)
        h = range_hash(prefix, g, g + gram(length))
        least = sliding(h, reach + 1, np.minimum)                 # of each window
        padded = np.concatenate([np.zeros(reach, dtype=np.uint64), least, np.zeros(reach, dtype=np.uint64)])
        place = np.flatnonzero(sliding(padded, reach + 1, np.maximum) == h)
        place = place[~np.isin(g[place] + base, seen)]
        p = g[place]
        seen = np.append(seen, p + base)
        seen = seen[seen >= at + BLOCK]
        lo, hi = np.maximum(p - reach, 0 if base == 0 else p - reach), np.minimum(p + length, len(part))
        context = mix(range_hash(prefix, lo, hi) + mix((p - lo).astype(np.uint64) * MULT + (hi - p).astype(np.uint64)))
        yield p + base, h[place], context, lo + base, hi + base


def _named(docs: DataFrame, text: str, key: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(t.alias("text"), text_id(key, text).alias("text_id"))


def text_id(key: str, text: str):
    return F.xxhash64(F.col(key), F.coalesce(F.col(text), F.lit("")))


def anchor_table(docs: DataFrame, length: int, text: str, key: str) -> DataFrame:
    """(text_id, at, anchor, context, before, after, c): the different contexts of each text, their bytes before and after
    the place ``at`` and how often they occur in it.  Contexts that occur again in their text are repeated: the bytes
    that such contexts cover are rows with c = 0 and no anchor."""

    def find(batches):
        for batch in batches:
            out, size = [], 0
            for t, i in zip(text_bytes(batch.column(0)), batch.column(1).to_pylist()):
                found = list(anchors(t, length))
                if not found:
                    continue
                p, h, c, lo, hi = (np.concatenate(x) for x in zip(*found))
                ctx = mix(h ^ mix(c))
                _, first, which, n = np.unique(ctx, return_index=True, return_inverse=True, return_counts=True)
                if len(first) < len(p):
                    again = (n[which] > 1) & (hi - lo >= length)
                    a, b = merge_runs(lo[again], hi[again])
                    none = np.zeros(len(a), dtype=np.int64)
                    out.append((none + i, a, none, none, none, b - a, none))
                p, lo, hi = p[first], lo[first], hi[first]
                out.append((np.full(len(first), i, dtype=np.int64), p, h[first].view(np.int64), c[first].view(np.int64), p - lo, hi - p, n))
                size += len(first)
                if size > 100_000:
                    yield _columns(out, _ANCHORS)
                    out, size = [], 0
            if out:
                yield _columns(out, _ANCHORS)

    return _named(docs, text, key).mapInArrow(find, ", ".join(f"{n} bigint" for n in _ANCHORS))


_ANCHORS = ("text_id", "at", "anchor", "context", "before", "after", "c")
_INTERVALS = ("core", "span", "text_id", "at", "step", "lo", "hi")


def _columns(parts, names) -> pa.RecordBatch:
    cols = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0)] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=list(names))


def merge_runs(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of the ranges [lo, hi); lo ascends."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, upto = lo[order], np.maximum.accumulate(hi[order])
    new = np.append(True, lo[1:] > upto[:-1])
    return lo[new], upto[np.append(np.flatnonzero(new)[1:] - 1, len(lo) - 1)]


@lru_cache
def steps(length: int, number: int) -> np.ndarray:
    """Intervals (first, last) of the offsets of an anchor."""
    edges = np.linspace(0, length - gram(length) + 1, number + 1).astype(np.int64)
    return np.array([(a, b - 1) for a, b in zip(edges, edges[1:]) if b > a])


def cut(text, p: np.ndarray, h: np.ndarray, length: int, number: int):
    """The ``number`` intervals of the anchors ``p`` of a text: core hash, span hash, place, step, lo, hi."""
    base, end = max(0, int(p.min()) - length), min(len(text), int(p.max()) + length)
    prefix = prefix_hash(np.frombuffer(text[base:end], dtype=np.uint8))
    grid = steps(length, number)
    at, hashes = np.repeat(p, len(grid)), np.repeat(h, len(grid))
    step = np.tile(np.arange(len(grid)), len(p))
    a, b = grid[step].T
    ok = (at >= a) & (at - b + length <= len(text)) & (np.maximum(at - b, 0) + length <= np.minimum(at - a + length, len(text)))
    q, a, b, step = at[ok], a[ok], b[ok], step[ok]
    core = mix(range_hash(prefix, q - a - base, q - b + length - base) + mix(hashes[ok]) + step.astype(np.uint64))
    lo, hi = np.maximum(q - b, 0), np.minimum(q - a + length, len(text))
    span = mix(core ^ mix(range_hash(prefix, lo - base, hi - base) + mix((q - lo).astype(np.uint64) * MULT + (hi - q).astype(np.uint64))))
    return core, span, q, step, lo, hi


def places_of(batch, texts, places, length: int):
    """(text, text_id, places, anchors) of the anchors in the bitmap ``places`` of the texts in the bitmap ``texts``."""
    names = batch.column(1).to_numpy(zero_copy_only=False)
    for t, i, use in zip(text_bytes(batch.column(0)), names.tolist(), in_bitmap(texts.value, mix(names.view(np.uint64)))):
        if not use:                                # no place in this text
            continue
        for p, h, *_ in anchors(t, length):
            u = in_bitmap(places.value, place_hash(np.full(len(p), i, dtype=np.int64), p))
            if u.any():
                yield t, i, p[u], h[u]


def contexts(docs: DataFrame, texts, places, length: int, text: str, key: str) -> DataFrame:
    """Columns _CONTEXTS: the contexts of the places, by their anchors."""

    def find(batches):
        for batch in batches:
            rows, size = [], 0
            for t, i, p, h in places_of(batch, texts, places, length):
                lo, hi = np.maximum(p - (length - gram(length)), 0), np.minimum(p + length, len(t))
                rows += [(c, i, a, bytes(t[a:b])) for c, a, b in zip(h.view(np.int64).tolist(), lo.tolist(), hi.tolist())]
                size += int((hi - lo).sum())
                if size > 4 << 20:
                    yield _spans(rows, _CONTEXTS)
                    rows, size = [], 0
            yield _spans(rows, _CONTEXTS)

    return _named(docs, text, key).mapInArrow(find, ", ".join(f"{n} {k}" for n, k in _CONTEXTS))


def intervals(docs: DataFrame, texts, places, length: int, number: int, wanted, large, text: str, key: str) -> DataFrame:
    """Intervals of the places (columns _INTERVALS).  With the bitmap ``wanted`` of interval rows: only these, with their
    bytes (columns _SPANS); ``large`` (a bitmap of cores) tells which are hot."""

    def find(batches):
        for batch in batches:
            out, rows, size = [], [], 0
            for t, i, p, h in places_of(batch, texts, places, length):
                core, span, q, step, lo, hi = cut(t, p, h, length, number)
                name = np.full(len(q), i, dtype=np.int64)
                if wanted is None:
                    out.append((core.view(np.int64), span.view(np.int64), name, q, step, lo, hi))
                    size += 40 * len(q)
                else:
                    k = np.flatnonzero(in_bitmap(wanted.value, row_hash(name, q, step)))
                    for c, big, at, a, b in zip(core[k].view(np.int64).tolist(), in_bitmap(large.value, core[k]).tolist(), q[k].tolist(), lo[k].tolist(), hi[k].tolist()):
                        rows.append((c, big, i, at, a, bytes(t[a:b])))
                        size += b - a
                if size > 4 << 20:
                    yield _columns(out, _INTERVALS) if wanted is None else _spans(rows)
                    out, rows, size = [], [], 0
            yield _columns(out, _INTERVALS) if wanted is None else _spans(rows)

    schema = ", ".join(f"{n} bigint" for n in _INTERVALS) if wanted is None else ", ".join(f"{n} {k}" for n, k in _SPANS)
    return _named(docs, text, key).mapInArrow(find, schema)


def among(df: DataFrame, column: str, bits) -> DataFrame:
    """The rows whose hash of ``column`` is in the bitmap; a few others may stay."""

    def keep(batches):
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(bits.value, batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).view(np.uint64))))

    hashed = df.withColumn("h", F.xxhash64(column))
    return hashed.mapInArrow(keep, hashed.schema).drop("h")


_CONTEXTS = (("core", "bigint"), ("text_id", "bigint"), ("lo", "bigint"), ("bytes", "binary"))
_SPANS = (("core", "bigint"), ("hot", "boolean"), ("text_id", "bigint"), ("at", "bigint"), ("lo", "bigint"), ("bytes", "binary"))


def _spans(rows, columns=_SPANS) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    cols = list(zip(*rows)) or [()] * len(columns)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, columns)], names=[n for n, _ in columns])


def row_hash(text_ids: np.ndarray, at: np.ndarray, step: np.ndarray) -> np.ndarray:
    return mix(place_hash(text_ids, at) + step.astype(np.uint64) * MULT)


def place_hash(text_ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    return mix(mix(text_ids.view(np.uint64)) + at.astype(np.uint64))


# --- the run-length index ----------------------------------------------------------

def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes.  Symbols are 1 to 256, 0 ends a segment; ends differ from each
    other and sort by place.  Prefix doubling from seven symbols on."""
    n, first = len(symbols), 7
    padded = np.append(symbols, np.zeros(first, dtype=np.int64))
    grams = np.zeros(n, dtype=np.int64)
    ended = np.zeros(n, dtype=bool)
    for i in range(first):
        s = padded[i:i + n]
        grams = grams * 257 + np.where(ended, 0, s)
        ended |= s == 0
    order = np.argsort(grams)
    done = ended[order]                                  # equal ones stand together, in any order: sort them by place
    closed = order[done]
    order[done] = closed[np.lexsort((closed, grams[closed]))]
    new = np.append(True, (grams[order][1:] != grams[order][:-1]) | done[1:])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    step = first
    while True:
        last = np.append(new[1:], True)
        open_ = np.flatnonzero(~(new & last))            # places of the order that are still tied
        if not len(open_):
            return order
        who = order[open_]
        after = rank[np.minimum(who + step, n - 1)]
        by = np.argsort((rank[who] << 32) | after)
        who = who[by]
        order[open_] = who
        pair, nxt = rank[who], rank[np.minimum(who + step, n - 1)]
        new[open_] = np.append(True, (pair[1:] != pair[:-1]) | (nxt[1:] != nxt[:-1]))
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[who] = start[open_]
        step *= 2


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of segments with the suffixes sampled at the
    starts and ends of runs, and the length of the match of each sample with its neighbour."""

    def __init__(self, segments: list[bytes], least: int = 1) -> None:
        """``least``: shorter matches count as none."""
        sizes = np.array([len(s) + 1 for s in segments])
        self.starts = np.cumsum(sizes) - sizes
        n = int(sizes.sum())
        symbols = np.zeros(n, dtype=np.int64)
        owner = np.repeat(np.arange(len(segments)), sizes)
        inside = np.ones(n, dtype=bool)
        inside[self.starts + sizes - 1] = False
        symbols[inside] = np.frombuffer(b"".join(segments), dtype=np.uint8).astype(np.int64) + 1
        order = suffix_order(symbols)
        before = np.where(order > 0, symbols[order - 1], 0)
        before = np.where(before == 0, -1 - owner[order], before)            # ends differ from each other
        head = np.append(True, before[1:] != before[:-1])
        self.n = n
        self.runs = before[head]                                             # the transform, one symbol a run
        self.run_at = np.flatnonzero(head)
        tail = np.append(head[1:], True)
        self.left = self.room(owner, sizes)
        self.least = least
        ends = np.flatnonzero(tail)
        self.first, self.last = order[self.run_at], order[ends]              # samples
        prefix = prefix_hash(np.where(symbols == 0, 0, symbols))
        self.first_match = self.common(prefix, self.first, order[np.maximum(self.run_at - 1, 0)], self.run_at > 0)
        self.last_match = self.common(prefix, self.last, order[np.minimum(ends + 1, n - 1)], ends < n - 1)

    def room(self, owner: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return (self.starts + sizes - 1)[owner] - np.arange(len(owner))

    def common(self, prefix, a, b, valid) -> np.ndarray:
        """Length of the common prefix of the suffixes a and b, inside their segments."""
        out = np.zeros(len(a), dtype=np.int64)
        most = np.minimum(self.left[a], self.left[b])
        use = np.flatnonzero(valid & (most >= self.least))
        use = use[range_hash(prefix, a[use], a[use] + self.least) == range_hash(prefix, b[use], b[use] + self.least)]
        a, b, hi = a[use], b[use], most[use]
        lo = np.full(len(use), self.least, dtype=np.int64)
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            same = range_hash(prefix, a, a + mid) == range_hash(prefix, b, b + mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        out[use] = lo
        return out

    def matching(self) -> np.ndarray:
        """For each place of the text the longest match that starts at another place.  Streams over the
        text: between two samples of a direction, the match shrinks by one for each symbol."""
        best = np.zeros(self.n, dtype=np.int64)
        for places, match in ((self.first, self.first_match), (self.last, self.last_match)):
            end = np.full(self.n, -1, dtype=np.int64)
            end[places] = np.arange(len(places))
            sample = np.maximum.accumulate(np.where(end >= 0, np.arange(self.n), 0))
            best = np.maximum(best, match[end[sample]] - (np.arange(self.n) - sample))
        return np.maximum(best, 0)


def covered(long: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by strings of ``length`` that start at the marked places."""
    at = np.flatnonzero(long)
    if not len(at):
        return at, at
    gap = np.flatnonzero(at[1:] > at[:-1] + length)
    return at[np.append(0, gap + 1)], at[np.append(gap, len(at) - 1)] + length


def index_spans(rows: list[tuple], length: int):
    """rows: (text_id, lo, bytes).  Yields (text_id, start, end) of repeated strings among them."""
    rows = sorted(rows, key=lambda r: (r[0], r[1]))
    segments, names = [], []
    for doc, lo, data in rows:
        if names and names[-1][0] == doc and lo <= names[-1][1] + len(segments[-1]):
            seg = segments[-1]
            seg += data[max(0, names[-1][1] + len(seg) - lo):]
        else:
            names.append((doc, lo))
            segments.append(bytearray(data))
    if not segments:
        return
    index = RunIndex([bytes(s) for s in segments], length)
    long = index.matching() >= length
    bounds = np.append(index.starts, index.n)
    lo, hi = covered(long, length)
    seg = np.searchsorted(bounds, lo, side="right") - 1
    for s, a, b in zip(seg.tolist(), (lo - bounds[seg]).tolist(), (hi - bounds[seg]).tolist()):
        yield names[s][0], names[s][1] + a, names[s][1] + b


def repeated(docs: DataFrame, length: int = 400, most: int = 1000, target: int = 1 << 20, number: int = 4,
             text: str = "text", key: str = "doc_id") -> tuple[DataFrame, list[DataFrame]]:
    """(text_id, start, stop): strings of bytes that are repeated, in texts named by ``text_id(key, text)``;
    they overlap.  With them the stored tables that they are read from."""
    share = small_batches(docs).sparkSession.sparkContext.broadcast                 # of bitmaps, all of fixed size
    bits = lambda df, column, less=0: share(bitmap(df.select(F.xxhash64(column).alias("h")), "h", LOG2_BITS - less))
    start, stop = F.expr("at - before").alias("start"), F.expr("at + after").alias("stop")
    found = stored(anchor_table(docs, length, text, key), "anchors")
    named = found.where("c > 0")
    kinds = stored(named.groupBy("anchor", "context").agg(F.sum("c").alias("c")), "kinds")
    again = kinds.where("c > 1").select("anchor", "context")
    whole = (among(named.select("text_id", "at", "anchor", "before", "after", "context"), "context", bits(again, "context"))
             .join(again, ["anchor", "context"], "left_semi").where(F.col("before") + F.col("after") >= length).select("text_id", start, stop))
    whole = stored(found.where("c = 0").select("text_id", start, stop).unionByName(whole), "whole")
    many = kinds.groupBy("anchor").agg(F.count("*").alias("m"), F.min("c").alias("least")).where("m > 1 and least = 1").select("anchor", "m")
    many = stored(many, "many")
    discard(kinds)
    place = F.min(F.struct("text_id", "at")).alias("place")                         # one of each context
    open_ = stored(among(named.select("text_id", "at", "context", "anchor"), "anchor", bits(many, "anchor")).groupBy("anchor", "context").agg(place)
                   .join(many, "anchor").select("m", "place.text_id", "place.at"), "open")
    discard(found, many)
    made, spans = [whole, open_], whole

    def index(batches):
        part = [r for batch in batches for r in zip(*(batch.column(i).to_pylist() for i in range(3)))]
        out = list(index_spans(part, length))
        yield _columns([tuple(np.array(x, dtype=np.int64) for x in zip(*out))] if out else [], ("text_id", "start", "stop"))

    def indexed(rows, size):
        return (rows.repartition(size // target + 1, "core").select("text_id", "lo", "bytes")
                .mapInArrow(index, "text_id bigint, start bigint, stop bigint"))

    def shared(rows):
        return (share(bitmap(rows.select("text_id").mapInArrow(_hash_texts, "h bigint"), "h", LOG2_BITS - 2)),
                share(bitmap(rows.select("text_id", "at").mapInArrow(_hash_places, "h bigint"), "h", LOG2_BITS)))

    few, lots = open_.where(F.col("m") <= most), open_.where(F.col("m") > most)
    n_few, n_lots = open_.agg(F.count_if(F.col("m") <= most), F.count_if(F.col("m") > most)).first()
    if n_few:
        rows = contexts(docs, *shared(few), length, text, key)
        spans = spans.unionByName(indexed(rows, n_few * (2 * length - gram(length))))
    if not n_lots:
        return spans, made

    texts, places = shared(lots)
    rows = stored(intervals(docs, texts, places, length, number, None, None, text, key), "intervals")
    pieces = stored(rows.groupBy("core", "span").agg(F.count("*").alias("n"), F.min(F.struct("text_id", "at", "step")).alias("row")), "pieces")
    again = pieces.where("n > 1").select("core", "span")
    twice = stored(among(rows.select("core", "text_id", "lo", "hi", "span"), "span", bits(again, "span", 4)).join(again, ["core", "span"], "left_semi")
                   .select("text_id", F.col("lo").alias("start"), F.col("hi").alias("stop")), "twice")
    discard(rows)
    cores = stored(pieces.groupBy("core").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1").select("core", "m"), "cores")
    left = stored(among(pieces.select("row", "core"), "core", bits(cores, "core", 4)).join(cores, "core").select("core", "m", "row.text_id", "row.at", "row.step"), "left")
    discard(pieces, cores)
    wanted = share(bitmap(left.select("text_id", "at", "step").mapInArrow(_hash_rows, "h bigint"), "h", LOG2_BITS))
    large = share(bitmap(left.where(F.col("m") > most), "core", LOG2_BITS - 4))
    texts = share(bitmap(left.select("text_id").mapInArrow(_hash_texts, "h bigint"), "h", LOG2_BITS - 2))
    rest = stored(intervals(docs, texts, places, length, number, wanted, large, text, key), "rest")
    size = rest.where("not hot").agg(F.coalesce(F.sum(F.length("bytes")), F.lit(0))).first()[0]

    def windows(batches):
        for batch in batches:
            out = []
            for core, doc, at, lo, data in zip(*(batch.column(i).to_pylist() for i in range(5))):
                data = np.frombuffer(data, dtype=np.uint8)
                a = np.arange(len(data) - length + 1)
                h = mix(range_hash(prefix_hash(data), a, a + length) + mix((at - lo - a).astype(np.uint64)) + np.uint64(core & (2**64 - 1)))
                out.append((h.view(np.int64), np.full(len(a), doc, dtype=np.int64), a + lo))
            yield _columns(out, ("h", "text_id", "start"))

    def split(batches):
        for batch in batches:
            out = []
            for core, doc, at, lo, data in zip(*(batch.column(i).to_pylist() for i in range(5))):
                cores, kinds, _, _, a, b = cut(data, np.array([at - lo]), np.array([core]).view(np.uint64), length, number * number)
                out += [(c, k, doc, at, lo + x, data[x:y]) for c, k, x, y in zip(cores.view(np.int64).tolist(), kinds.view(np.int64).tolist(), a.tolist(), b.tolist())]
            cols = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 5 else pa.int64()) for k, c in enumerate(cols)], names=["core", "span", "text_id", "at", "lo", "bytes"])

    finer = stored(rest.where("hot").select("core", "text_id", "at", "lo", "bytes")
                   .mapInArrow(split, "core bigint, span bigint, text_id bigint, at bigint, lo bigint, bytes binary"), "finer")
    pieces = stored(finer.groupBy("core", "span").agg(F.count("*").alias("n")), "pieces")
    again = pieces.where("n > 1").select("core", "span")
    repeated_again = stored(among(finer.select("core", "text_id", "lo", F.octet_length("bytes").alias("n"), "span"), "span", bits(again, "span", 4))
                  .join(again, ["core", "span"], "left_semi").select("text_id", F.col("lo").alias("start"), (F.col("lo") + F.col("n")).alias("stop")), "twice")
    cores = stored(pieces.groupBy("core").agg(F.count("*").alias("m"), F.min("n").alias("least"), F.sum("n").alias("n")).where("m > 1 and least = 1"), "cores")
    discard(pieces)
    again_size = cores.where(F.col("m") <= most).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * (length + (length - gram(length)) // (number * number) + 1)
    finer_few = among(finer.select("text_id", "lo", "bytes", "core"), "core", bits(cores.where(F.col("m") <= most), "core", 4))
    finer_lots = among(finer.select("text_id", "at", "lo", "bytes", "core"), "core", bits(cores.where(F.col("m") > most), "core", 4))
    spans = spans.unionByName(repeated_again).unionByName(indexed(finer_few, again_size))
    shown = finer_lots.select("core", "text_id", "at", "lo", "bytes").mapInArrow(windows, "h bigint, text_id bigint, start bigint")
    place = F.struct("text_id", "start")
    same = shown.groupBy("h").agg(F.min(place).alias("x"), F.max(place).alias("y")).where("x != y").select("h")
    warm = shown.join(same, "h", "left_semi").select("text_id", "start", (F.col("start") + length).alias("stop"))
    return spans.unionByName(twice).unionByName(indexed(rest.where("not hot"), size)).unionByName(warm), [*made, twice, left, rest, finer, cores, repeated_again]


def _hash_texts(batches):
    for batch in batches:
        h = mix(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])


def _hash_places(batches):
    for batch in batches:
        h = place_hash(*(batch.column(i).to_numpy(zero_copy_only=False) for i in range(2)))
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])


def _hash_rows(batches):
    for batch in batches:
        h = row_hash(*(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)))
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])


def merged(spans: DataFrame) -> DataFrame:
    """(text_id, spans): the maximal removed runs of each text, in order."""
    each = spans.groupBy("text_id").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("each"))

    def join(batches):
        for batch in batches:
            ids, out = [], []
            for i, e in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                runs: list[list[int]] = []
                for s in e:
                    if runs and s["start"] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s["stop"])
                    else:
                        runs.append([s["start"], s["stop"]])
                ids.append(i)
                out.append([{"start": a, "stop": b} for a, b in runs])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, SPANS)], names=["text_id", "spans"])

    return each.mapInArrow(join, "text_id bigint, spans array<struct<start:bigint,stop:bigint>>")


def remove(docs: DataFrame, length: int = 400, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The documents with the columns ``_spans`` (removed runs of bytes) and ``_kept`` (remaining bytes), in place of input
    columns of these names."""
    docs = docs.drop("_spans", "_kept")
    own, hashed, named_text = (unused([*docs.columns, "_spans", "_kept"], x) for x in ("_id", "_hash", "_text"))
    found, made = repeated(docs, length, text=text, key=key, **options)
    spans = stored(merged(found), "spans")
    discard(*made)
    bits = small_batches(docs).sparkSession.sparkContext.broadcast(bitmap(spans.select(F.xxhash64("text_id").alias("h")), "h", LOG2_BITS - 4))
    named = spans.select(F.col("text_id").alias(named_text), F.col("spans").alias("_spans"))
    rows = docs.withColumn(own, text_id(key, text)).withColumn(hashed, F.xxhash64(own))
    at, width = docs.columns.index(text), len(docs.columns)
    given = docs.schema.fields
    schema = T.StructType([*given, named.schema["_spans"], T.StructField("_kept", T.BinaryType())])

    def some(batch, want):
        return batch.filter(pa.array(in_bitmap(bits.value, batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).view(np.uint64)) == want))

    def result(batch, column, spans, kept):
        columns = [column if k == at else c for k, c in enumerate(batch.columns[:width])]
        return pa.RecordBatch.from_arrays([*columns, pa.array(spans, SPANS), pa.array(kept, pa.binary())], names=schema.names)

    # texts without a span need no shuffle: a fixed-size bitmap tells them (some others go with the join, and find nothing there)
    def whole(batches):
        for batch in batches:
            batch = some(batch, False)
            yield result(batch, batch.column(at), [[]] * len(batch), [bytes(t) for t in text_bytes(batch.column(at))])

    # the others are compressed for it
    def pack(batches):
        for batch in batches:
            batch = some(batch, True)
            valid = batch.column(at).is_valid().to_pylist()
            column = [len(t).to_bytes(8, "little") + pa.compress(bytes(t), codec="zstd", asbytes=True) if v else None for t, v in zip(text_bytes(batch.column(at)), valid)]
            yield pa.RecordBatch.from_arrays([pa.array(column, pa.binary()) if k == at else c for k, c in enumerate(batch.columns[:-1])], names=batch.schema.names[:-1])

    def cut_out(batches):
        for batch in batches:
            texts, kept = [], []
            found = [s or [] for s in batch.column(width).to_pylist()]
            for t, spans_of in zip(batch.column(at).to_pylist(), found):
                t = t and pa.decompress(t[8:], decompressed_size=int.from_bytes(t[:8], "little"), codec="zstd", asbytes=True)
                pieces, last = [], 0
                for s in spans_of:
                    pieces.append(t[last:s["start"]])
                    last = s["stop"]
                texts.append(t)
                kept.append(b"".join([*pieces, (t or b"")[last:]]))
            yield result(batch, pa.array(texts, pa.binary()).cast(pa.string()), found, kept)

    small = T.StructType([*(T.StructField(f.name, T.BinaryType()) if k == at else f for k, f in enumerate(given)), T.StructField(own, T.LongType())])
    touched = rows.mapInArrow(pack, small).join(named, F.col(own) == F.col(named_text), "left").drop(own, named_text)
    return touched.mapInArrow(cut_out, schema).unionByName(rows.mapInArrow(whole, schema))


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
