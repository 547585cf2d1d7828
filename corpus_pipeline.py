"""A training-data pipeline over ``documents``: each stage works on all that the stage
before kept, written as Parquet and read again.

1. language: documents whose language is rejected go.
2. lines: boilerplate lines of many sources go; a document left without a word goes.
3. near_duplicates: of linked documents the one of the smallest doc_id stays.
4. decontaminate: documents with a passage of the benchmark go.
5. pack: token ids of what remains, packed into sequences (one row for each piece).

All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from acreage.llm import decontaminate, jaccard, language, lines, packing
from acreage.llm.common import shared_dir, table, unused
from acreage.llm.token_path import BYTE_BPE

CAPACITY = 2048
WORD = "[^ \\t\\n\\u000B\\f\\r]"


def language_stage(spark, docs, sf_dir):
    return language.keep(docs)


def lines_stage(spark, docs, sf_dir):
    out = unused(docs.columns, "_lines")
    rows = lines.remove(docs, least_sites=10, out=out)
    emptied = (F.col(f"{out}.removed") > 0) & ~F.col("text").rlike(WORD)
    rows = rows.where(~F.coalesce(emptied, F.lit(False)))
    changed = F.col(f"{out}.removed") > 0
    return rows.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).drop(out)


def near_duplicates_stage(spark, docs, sf_dir):
    return jaccard.keep_one(docs)


def decontaminate_stage(spark, docs, sf_dir):
    return decontaminate.drop_hit(docs, table(spark, sf_dir, "benchmark"))


def pack_stage(spark, docs, sf_dir):
    pieces = packing.pieces(docs, BYTE_BPE, capacity=CAPACITY)
    return packing.pack(pieces, CAPACITY)


STAGES = [
    ("language", language_stage),
    ("lines", lines_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontaminate", decontaminate_stage),
    ("pack", pack_stage),
]

# Neither a trained model nor a tokenizer can be stated in SQL; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages; the rows of the last one, with the ids as their checksum."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
