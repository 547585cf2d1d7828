"""Operator 8: benchmark decontamination by a prefix-filtered set join.

A window is ``window`` consecutive words of a benchmark item (a shorter item is one
window).  A window is a set of shingles of ``shingle`` words (a shorter window is one
shingle).  It occurs in a document only if all its shingles do, so it is enough to
join one: its prefix, the shingle that is rarest in the whole corpus.  A window whose
rarest shingle occurs nowhere is dropped.  For each place of a prefix the bounds follow
from its position in the window (the window must begin and end inside the document),
and the words of the window are compared exactly.

The texts are read once.  A bitmap of the benchmark's shingles (fixed size, no false
negatives) picks the places that are written out with the words around them; everything
after that is joins and sums on these.  Shingle counts are over all documents.

Defined results: null or empty texts have no words; null items and items without words
give no windows; equal items and repeated rows each count; a null key is kept; empty
tables give no hits or no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreage.llm.common import bitmap, in_bitmap, list_array, shingle_hashes, small_batches, stored, text_bytes, unused, word_hashes

WORD = np.zeros(256, dtype=bool)
WORD[ord("0"):ord("9") + 1] = True
WORD[ord("a"):ord("z") + 1] = True
WORD[0x80:] = True
LOG2_BITS = 26


def _lower_words(text, starts, ends) -> list[bytes]:
    return [bytes(text[a:b]).lower() for a, b in zip(starts.tolist(), ends.tolist())]   # bytes.lower: A-Z only


def windows(items: DataFrame, window: int = 10, shingle: int = 5, text: str = "text", key: str = "item_id") -> DataFrame:
    """(item_id, words, n, shingles): each window of each item, words joined by a blank."""
    kind = dict(items.dtypes)[key]

    def cut(batches):
        for batch in batches:
            ids, words, n, sizes, flat = [], [], [], [], []
            for i, t in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                h, s, e = word_hashes(t, WORD)
                if not len(h):
                    continue
                w = _lower_words(t, s, e)
                m = min(window, len(w))
                k = min(shingle, m)
                hashes = shingle_hashes(h, k)
                for a in range(len(w) - m + 1):
                    ids.append(i)
                    words.append(b" ".join(w[a:a + m]).decode("utf-8", "replace"))
                    n.append(m)
                    sizes.append(m - k + 1)
                    flat.append(hashes[a:a + m - k + 1])
            flat = np.concatenate(flat).view(np.int64) if flat else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(words, pa.string()), pa.array(n, pa.int32()), list_array(flat, sizes, pa.int64())],
                                             names=["item_id", "words", "n", "shingles"])

    return items.select(F.col(key).alias("item_id"), F.col(text).alias("text")).mapInArrow(cut, f"item_id {kind}, words string, n int, shingles array<bigint>")


def places(docs: DataFrame, bits, lengths: list[int], window: int, shingle: int, text: str, key: str) -> DataFrame:
    """Per document: row, doc_id, n_words and the places of benchmark shingles: position,
    hash and the words from ``window - 1`` before to ``window`` after."""
    kind = dict(docs.dtypes)[key]

    def find(batches):
        from pyspark import TaskContext
        row = TaskContext.get().partitionId() << 33
        table = bits.value
        for batch in batches:
            n_words, sizes, at, hashes, around = [], [], [], [], []
            for t in text_bytes(batch.column(1)):
                h, s, e = word_hashes(t, WORD)
                n_words.append(len(h))
                found = 0
                for k in lengths:
                    if len(h) < k:
                        continue
                    x = shingle_hashes(h, k)
                    hit = np.flatnonzero(in_bitmap(table, x))
                    for p in hit.tolist():
                        lo, hi = max(0, p - window + 1), min(len(h), p + window)
                        around.append(b" ".join(_lower_words(t, s[lo:hi], e[lo:hi])).decode("utf-8", "replace"))
                    at.append(hit)
                    hashes.append(x[hit])
                    found += len(hit)
                sizes.append(found)
            ids = np.arange(row, row + batch.num_rows)
            row += batch.num_rows
            at = np.concatenate(at) if at else np.zeros(0)
            hashes = np.concatenate(hashes).view(np.int64) if hashes else np.zeros(0, dtype=np.int64)
            offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
            hits = pa.StructArray.from_arrays([pa.array(at.astype(np.int32)), pa.array(hashes), pa.array(around, pa.string())], names=["at", "shingle", "around"])
            yield pa.RecordBatch.from_arrays([pa.array(ids), batch.column(0), pa.array(n_words, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), hits)],
                                             names=["row", "doc_id", "n_words", "hits"])

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        find, f"row bigint, doc_id {kind}, n_words bigint, hits array<struct<at:int,shingle:bigint,around:string>>")


def find_windows(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 5,
                 doc_text: str = "text", doc_key: str = "doc_id", item_text: str = "text", item_key: str = "item_id"):
    """(documents, matches, windows): row, doc_id, n_words of every document; row, start, n, words
    of every occurrence; item_id, words of every window."""
    spark = small_batches(docs).sparkSession
    wins = stored(windows(items, window, shingle, item_text, item_key), "windows")
    lengths = sorted(r.k for r in wins.select(F.least("n", F.lit(shingle)).alias("k")).distinct().collect())   # 1 to shingle
    bits = spark.sparkContext.broadcast(bitmap(wins.select(F.explode("shingles").alias("s")), "s", LOG2_BITS))  # 2^LOG2_BITS bits
    documents = stored(places(docs, bits, lengths, window, shingle, doc_text, doc_key), "places")
    hits = documents.where(F.size("hits") > 0).select("row", "n_words", F.inline("hits"))
    rarity = hits.groupBy("shingle").agg(F.count("*").alias("df"))
    each = (wins.dropDuplicates(["words"]).select("words", "n", F.posexplode("shingles").alias("o", "shingle"))
            .join(rarity, "shingle", "left"))
    prefix = (each.groupBy("words", "n").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "o", "shingle")).alias("p"))
              .where("p.df > 0").select("words", "n", "p.o", "p.shingle"))
    start = F.col("at") - F.col("o")
    inside = (start >= 0) & (start + F.col("n") <= F.col("n_words"))
    first = start - F.greatest(F.col("at") - (window - 1), F.lit(0))
    same = F.array_join(F.slice(F.split("around", " "), first + 1, F.col("n")), " ") == F.col("words")
    matches = hits.join(prefix, "shingle").where(inside).where(same).select("row", start.alias("start"), "n", "words")
    return documents.select("row", "doc_id", "n_words"), matches, wins.select("item_id", "words")


def report(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 5, **names: str) -> DataFrame:
    """Per document: row, doc_id, n_words, n_hit (words inside occurring windows), the sorted
    ``spans`` (start, end in words) and the sorted ``items`` as strings."""
    documents, matches, wins = find_windows(docs, items, window, shingle, **names)
    matches = stored(matches, "matches")
    spans = (matches.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("stop")))).alias("each"))
             .withColumn("n_hit", F.expr("aggregate(each, struct(0L as n, 0 as upto), (a, x) -> struct(a.n + greatest(0, x.stop - greatest(x.start, a.upto)) as n, greatest(a.upto, x.stop) as upto)).n")))
    found = (matches.select("row", "words").distinct().join(wins.distinct(), "words")
             .groupBy("row").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items")))
    return (documents.join(spans, "row", "left").join(found, "row", "left")
            .select("row", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce("each", F.expr("cast(array() as array<struct<start:int,stop:int>>)")).alias("spans"),
                    F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items")))


def drop_hit(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 5, text: str = "text", key: str = "doc_id", **names: str) -> DataFrame:
    """The documents in which no window occurs."""
    same = docs.select(F.xxhash64(F.col(key), F.col(text)).alias("_row"), F.col(text).alias("_text"))
    documents, matches, _ = find_windows(same, items, window, shingle, doc_text="_text", doc_key="_row", **names)
    name = unused(docs.columns, "_hit")
    hit = documents.join(matches.select("row").distinct(), "row", "left_semi").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(hit, F.xxhash64(F.col(key), F.col(text)) == F.col(name), "left_anti")
