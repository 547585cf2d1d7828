"""Operator 1: best-fit packing of documents into fixed-length sequences.

Best fit decreasing, matched by one loop on the driver.  Pieces are range-sorted by length and get their rank
among the pieces of equal length.  Rounds go from the longest pieces to the
shortest: a sweep finds the tightest gaps that hold the length (its successors in
the sorted gaps), the r-th piece takes the r-th of these gaps, the gaps shrink, and
the sweep repeats until the pieces of that length are placed; new sequences open
only when no gap is left.  Pieces of equal length and gaps of equal room are
interchangeable, so a round works on runs: (length, count) and (room, first
sequence, count).  There are at most ``capacity`` lengths and a few thousand runs
however many documents there are; only these runs reach the driver.  Ranking and
placing the pieces themselves is distributed work, and a frequent length is split
by the range sort like any other.

Defined results: a null or empty text is a document of one end id; equal documents
are packed one by one; a null doc_id is kept; an empty table gives no rows; other
columns of the input are kept by ``pack`` and not read by ``pieces``.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acreage.llm.common import small_batches, stored, text_bytes, unused
from acreage.llm.tokens import encoder

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids binary"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, text: str = "text",
           key: str = "doc_id") -> DataFrame:
    """Token ids (little-endian unsigned 32-bit) of whole texts plus ``end_id``; a document
    beyond ``capacity`` is cut into full pieces, the first of which may be shorter."""

    def cut(batches):
        tok = encoder(tokenizer)
        for batch in batches:
            rows = {"doc_id": [], "piece": [], "start": [], "length": [], "ids": []}

            def flush():
                out = pa.RecordBatch.from_pydict(rows, schema=pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())]))
                for v in rows.values():
                    v.clear()
                return out

            size = 0
            for doc, ids in zip(batch.column(0).to_pylist(), tok.encode(text_bytes(batch.column(1)))):
                ids = np.append(ids, end_id).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                edges = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    for name, v in zip(rows, (doc, k, a, b - a, ids[a:b].tobytes())):
                        rows[name].append(v)
                size += len(ids)
                if size > 1_000_000:
                    yield flush()
                    size = 0
            yield flush()

    return small_batches(docs).select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, PIECES)


def plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, ...]:
    """Rounds of best fit over runs.  ``counts``: pieces of each length.  Returns rows
    (length, first rank, first sequence, offset): the piece of that length and rank r
    goes to sequence first sequence + r - first rank, at that offset, for the last row
    whose first rank is at most r."""
    rooms: list[int] = []                      # sorted rooms that have gaps
    runs: dict[int, deque] = {}                # room -> runs (first sequence, count)

    def add(room: int, first: int, n: int) -> None:
        if room > 0:
            if room not in runs:
                insort(rooms, room)
                runs[room] = deque()
            runs[room].append((first, n))

    rows, sequences = [], 0
    for length in sorted(counts, reverse=True):
        rank, total = 0, counts[length]
        while rank < total:
            i = bisect_left(rooms, length)     # the tightest gaps that hold it
            if i == len(rooms):
                n = -(-(total - rank) // (capacity // length))
                add(capacity, sequences, n)
                sequences += n
                continue
            room = rooms[i]
            first, n = runs[room].popleft()
            if n > total - rank:
                runs[room].appendleft((first + total - rank, n - (total - rank)))
                n = total - rank
            elif not runs[room]:
                del runs[room], rooms[i]
            rows.append((length, rank, first, capacity - room))
            add(room - length, first, n)
            rank += n
    cols = np.array(rows, dtype=np.int64).reshape(-1, 4)
    cols = cols[np.lexsort((cols[:, 1], cols[:, 0]))]
    return tuple(np.ascontiguousarray(cols[:, i]) for i in range(4))


def pack(items: DataFrame, capacity: int = 2048, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a length of 1 to ``capacity``, in place of input columns of these names."""
    items = items.drop("sequence_id", "offset")
    dealt, ranks = unused(items.columns, "_part"), unused(items.columns, "_rank")
    add = T.StructType([T.StructField(dealt, T.IntegerType()), T.StructField(ranks, T.LongType())])
    schema = T.StructType(items.schema.fields + add.fields)

    def rank(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        last, seen = None, 0                   # sorted: a length is one run of rows
        for batch in batches:
            n = batch.column(batch.schema.get_field_index(length)).to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(n):
                continue
            head = np.flatnonzero(np.append(True, n[1:] != n[:-1]))
            run = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(n))))
            r = np.arange(len(n)) - head[run]
            r[run == 0] += seen if n[0] == last else 0
            last, seen = int(n[-1]), int(r[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(n), part, dtype=np.int32)), pa.array(r)],
                                             names=[*batch.schema.names, dealt, ranks])

    keys = [F.col(length).desc(), *map(F.col, order)]
    items = stored(items, "pieces")            # the range sort reads its input twice
    ranked = stored(items.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(rank, schema), "ranked")
    # at most one row for each length and partition border
    runs = ranked.groupBy(F.col(length).cast("bigint").alias("n"), F.col(dealt).alias("p")).agg(F.count("*").alias("c")).toArrow().to_pydict()
    counts: dict[int, int] = {}
    before: dict[tuple[int, int], int] = {}
    for n, part, c in sorted(zip(runs["n"], runs["p"], runs["c"])):
        before[n, part] = counts.get(n, 0)
        counts[n] = counts.get(n, 0) + c
    if counts and not 1 <= min(counts) <= max(counts) <= capacity:
        raise ValueError(f"lengths must be 1 to {capacity}")
    by, first, sequence, offset = plan(counts, capacity)
    wide = max(counts.values(), default=0) + 1
    index = by * wide + first
    at = np.array(sorted(before), dtype=np.int64).reshape(-1, 2)
    at_key, at_rank = (at[:, 0] << 32) + at[:, 1], np.array([before[x] for x in sorted(before)], dtype=np.int64)

    def place(batches):
        for batch in batches:
            def col(name):
                return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False).astype(np.int64)
            n = col(length)
            if not len(n):
                continue
            r = col(ranks) + at_rank[np.searchsorted(at_key, (n << 32) + col(dealt))]
            row = np.searchsorted(index, n * wide + r, side="right") - 1
            keep = [i for i, name in enumerate(batch.schema.names) if name not in (dealt, ranks)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(sequence[row] + r - first[row]), pa.array(offset[row])],
                                             names=[*(batch.schema.names[i] for i in keep), "sequence_id", "offset"])

    out = T.StructType([*items.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(place, out)
