"""Operator 6: removal of boilerplate lines that spread over many sites.

For every different line (trimmed, compared by a 64-bit hash) a HyperLogLog sketch of
the sites it occurs in is built; sketches merge by aggregation, with map-side partial
sketches, so a line of a third of all documents is no hot key.  Lines whose estimate is
farther than ``margin`` standard errors from ``least_sites`` are decided by the sketch,
the lines near it get an exact distinct count.  Every occurrence of a line of at least
``least_sites`` sites is removed.

Defined results: null text stays null and blank lines are never boilerplate; a null
site counts as no site; repeated rows are treated alike; equal keys with other texts
are told apart by a hash of the text; an empty table gives no rows; a very long text is
cut into its lines, and a very long line is one hash; other columns pass through
``remove`` whatever their names, but one called like the output column is replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreage.llm.common import small_batches, stored, unused

BLANK_CHARS = " \t\n\u000b\f\r"


def occurrences(docs: DataFrame, text: str = "text", key: str = "doc_id", site: str = "source") -> DataFrame:
    """(doc, version, at, line, site): each line with a character; line is its hash, version that of the text."""
    rows = docs.select(F.col(key).alias("doc"), F.xxhash64(text).alias("version"), F.col(site).cast("string").alias("site"),
                       F.posexplode(F.split(text, "\n")).alias("at", "raw"))
    rows = rows.withColumn("raw", F.btrim("raw", F.lit(BLANK_CHARS))).where("raw != ''")
    return rows.select("doc", "version", "at", F.xxhash64("raw").alias("line"), "site")


def boilerplate(lines: DataFrame, least_sites: int = 10, lg_k: int = 10, margin: float = 6.0) -> DataFrame:
    """Hashes of the lines that occur in at least ``least_sites`` sites."""
    spread = stored(lines.where("site is not null").groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("sites")), "spread")
    near = math.ceil(margin * 1.04 / math.sqrt(1 << lg_k) * least_sites) + 1
    sure = spread.where(F.col("sites") > least_sites + near).select("line")
    unsure = spread.where((F.col("sites") <= least_sites + near) & (F.col("sites") >= least_sites - near)).select("line")
    exact = (lines.join(unsure, "line", "left_semi").groupBy("line").agg(F.count_distinct("site").alias("n"))
             .where(F.col("n") >= least_sites).select("line"))
    return sure.unionByName(exact)


def remove(docs: DataFrame, least_sites: int = 10, text: str = "text", key: str = "doc_id", site: str = "source", out: str = "_lines") -> DataFrame:
    """The documents without boilerplate lines, and the struct ``out`` (total, removed): lines with
    a character before, and how many of them went."""
    docs = docs.drop(out)
    found, marked = unused(docs.columns, "_found"), unused([*docs.columns, out], "_gone")
    lines = stored(occurrences(small_batches(docs), text, key, site), "lines")
    bad = stored(boilerplate(lines, least_sites), "boilerplate")
    per_doc = (lines.join(bad.withColumn("bad", F.lit(True)), "line", "left")
               .groupBy("doc", "version").agg(F.count_distinct("at").alias("total"), F.array_sort(F.collect_set(F.when(F.col("bad"), F.col("at")))).alias("gone")))
    per_doc = per_doc.select(F.struct("doc", "version", "total", "gone").alias(found))
    same = F.col(key).eqNullSafe(F.col(f"{found}.doc")) & (F.xxhash64(text) == F.col(f"{found}.version"))
    joined = docs.join(per_doc, same, "left")
    order = [f"`{c}`" for c in docs.columns]
    counts = F.struct(F.coalesce(f"{found}.total", F.lit(0)).cast("long").alias("total"), F.coalesce(F.size(f"{found}.gone"), F.lit(0)).cast("long").alias("removed")).alias(out)
    joined = joined.select(*order, counts, F.coalesce(f"{found}.gone", F.array().cast("array<int>")).alias(marked))
    position = docs.columns.index(text)

    def strip(batches):
        for batch in batches:
            texts, gone = batch.column(position), batch.column(batch.num_columns - 1)
            texts = pa.array([t if not g else _without(t, g) for t, g in zip(texts.to_pylist(), gone.to_pylist())], texts.type)
            columns = list(batch.columns[:-1])
            columns[position] = texts
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return joined.mapInArrow(strip, joined.drop(marked).schema)


def _without(text: str, gone: list[int]) -> str:
    parts = text.split("\n")
    keep = np.ones(len(parts), dtype=bool)
    keep[gone] = False
    return "\n".join(p for p, k in zip(parts, keep) if k)
