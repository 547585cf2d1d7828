"""A1: CSV whose quoted fields may span lines, read by many tasks a file.

Spark's ``multiLine`` reader gives a whole file to one task.  Here a file is read as lines, in splits of any
size.  A line break ends a record where the quotes before it are even in number:

1. Each split is reduced to one row: whether its quotes are odd in number, and its last line that would begin
   a record if the split began outside, or inside, a quoted field.
2. A running parity over the splits of a file tells how each began, and the record that its first lines belong to.
3. Lines are numbered within their split, so that they need no order afterwards.  A line that is a record is
   parsed as it is; only the lines of longer records are brought together.

Defined results: as Spark's ``multiLine`` reader with the escape character ``"``, for lines that end in ``\\n`` or
``\\r\\n`` (the former too where the header has line breaks of the other kind) and fields quoted in whole (a quote
inside a field without quotes would turn the parity, use ``io.read_csv`` for such files); the first record of each
file is its header; empty lines are skipped; a record that never ends holds the rest of its file; an empty file
gives no rows; a missing path raises.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acreage.session import ship_package

SPLIT = "file string, start bigint, odd int, last0 bigint, last1 bigint"
LINE = "file string, start bigint, no bigint, before int, after int, head0 bigint, head1 bigint, value string"


class Parity:
    """Running state over the lines of one split after the other (a task reads a split's lines in order)."""

    def __init__(self) -> None:
        self.at = None

    def parts(self, batch: pa.RecordBatch):
        """Of each run of lines of one split: (split it follows or None, slice, number, parity before and after, heads)."""
        starts = batch.column(2).to_numpy(zero_copy_only=False)
        files = batch.column(1).dictionary_encode()
        codes = files.indices.to_numpy(zero_copy_only=False)
        quotes = pc.count_substring(batch.column(0), '"').to_numpy(zero_copy_only=False).astype(np.int64)
        edges = np.flatnonzero((starts[1:] != starts[:-1]) | (codes[1:] != codes[:-1])) + 1
        for a, b in zip([0, *edges], [*edges, len(starts)]):
            here, ended = (files.dictionary[int(codes[a])].as_py(), int(starts[a])), None
            if here != self.at:
                ended = self.row()
                self.at, self.line, self.odd, self.last = here, 0, 0, [-1, -1]
            after = (self.odd + np.cumsum(quotes[a:b])) & 1
            before = np.append(self.odd, after[:-1])
            no = self.line + np.arange(b - a)
            heads = [np.maximum(np.maximum.accumulate(np.where(before == h, no, -1)), self.last[h]) for h in (0, 1)]
            self.line, self.odd, self.last = self.line + int(b - a), int(after[-1]), [int(h[-1]) for h in heads]
            yield ended, (int(a), int(b)), no, before, after, heads

    def row(self):
        return None if self.at is None else (*self.at, self.odd, *self.last)


def split_rows(batches):
    state = Parity()

    def batch_of(rows):
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=["file", "start", "odd", "last0", "last1"])

    for batch in batches:
        if batch.num_rows:
            rows = [ended for ended, *_ in state.parts(batch) if ended]
            if rows:
                yield batch_of(rows)
    if state.row():
        yield batch_of([state.row()])


def line_rows(batches):
    state = Parity()
    for batch in batches:
        if not batch.num_rows:
            continue
        for _, (a, b), no, before, after, heads in state.parts(batch):
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays(
                [part.column(1), part.column(2), pa.array(no, pa.int64()), pa.array(before, pa.int32()), pa.array(after, pa.int32()),
                 *[pa.array(h, pa.int64()) for h in heads], part.column(0)],
                names=["file", "start", "no", "before", "after", "head0", "head1", "value"])


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, no, record): the texts of all records, by the split and line in which they begin."""
    ship_package(spark)
    text = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)     # one row a split
    began = F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2
    splits = text.mapInArrow(split_rows, SPLIT).withColumn("state", began)
    own = F.when(F.col("state") == 0, F.col("last0")).otherwise(F.col("last1"))
    head = F.when(own >= 0, F.struct("start", own.alias("no")))
    splits = splits.withColumn("head", head).select("file", "start", "state", F.last("head", ignorenulls=True).over(earlier).alias("carried"))
    lines = text.mapInArrow(line_rows, LINE).join(splits, ["file", "start"])
    own = F.when(F.col("state") == 0, F.col("head0")).otherwise(F.col("head1"))
    lines = lines.select("file", "start", "no", "value", F.when(own >= 0, F.struct("start", own.alias("no"))).otherwise(F.col("carried")).alias("head"),
                         ((F.col("state") == F.col("before")) & (F.col("state") == F.col("after"))).alias("whole"))
    one = lines.where("whole").select("file", "start", "no", F.col("value").alias("record"))
    # lines of one record: as many as its text has
    more = (lines.where("not whole").groupBy("file", "head").agg(F.sort_array(F.collect_list(F.struct("start", "no", "value"))).alias("parts"))
            .select("file", "head.start", "head.no", F.array_join(F.col("parts.value"), "\n").alias("record")))
    return one.unionByName(more)


def read_csv_split(spark: SparkSession, path: str, schema: T.StructType, corrupt: bool = False) -> DataFrame:
    """Header CSV with a declared schema.  ``corrupt`` adds ``_corrupt_record``, the text of a record that does not fit."""
    fields = list(schema.fields) + ([T.StructField("_corrupt_record", T.StringType())] if corrupt else [])
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    opts = {"escape": '"', "quote": '"', "mode": "PERMISSIVE", "multiLine": "true"}
    if corrupt:
        opts["columnNameOfCorruptRecord"] = "_corrupt_record"
    rows = records(spark, path).where("not (start = 0 and no = 0)").withColumn("record", F.regexp_replace("record", "\\r$", ""))
    return rows.where("record != ''").select(F.from_csv("record", ddl, opts).alias("row")).select("row.*")
