"""Registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from acreage.llm import oracles
from acreage.llm.common import table
from acreage.llm.token_path import BYTE_BPE, PIECES_32K

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {"op4_secret_scan": oracles.SECRETS, "op6_line_dedup": oracles.LINES, "op7_quality_rules": oracles.QUALITY,
                          "op8_decontamination": oracles.DECONTAMINATION, "op11_periodic_runs": oracles.PERIODIC,
                          "op12_warc": oracles.WARC, "op13_filter_audit": oracles.AUDIT}


def query(fn: Callable) -> Callable:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_best_fit_packing(spark, sf_dir):
    from acreage.llm import packing
    rows = packing.pieces(table(spark, sf_dir, "documents"), BYTE_BPE, capacity=2048, end_id=0)
    rows = rows.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(rows, capacity=2048)


@query
def op5_token_files(spark, sf_dir):
    from acreage.llm import token_files
    manifest = token_files.write(table(spark, sf_dir, "documents"), BYTE_BPE, end_id=2)
    return token_files.read(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op7_quality_rules(spark, sf_dir):
    from acreage.llm import quality
    return quality.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op4_secret_scan(spark, sf_dir):
    from acreage.llm import secrets
    rows = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["o"] < len(secrets.BASE))
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{r.kind}')) as long)").alias(f"n_{r.kind}") for r in secrets.BASE]
    return rows.select("doc_id", *counts, F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


@query
def op6_line_dedup(spark, sf_dir):
    from acreage.llm import lines
    rows = lines.remove(table(spark, sf_dir, "documents"), least_sites=10)
    return rows.select("doc_id", F.col("_lines.total").alias("n_lines"), F.col("_lines.removed").alias("n_removed"),
                       F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query
def op8_decontamination(spark, sf_dir):
    from acreage.llm import decontaminate
    rows = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query
def op10_token_counts(spark, sf_dir):
    from acreage.llm import token_counts
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), PIECES_32K)


@query
def op2_language_id(spark, sf_dir):
    from acreage.llm import language
    docs = table(spark, sf_dir, "documents")
    rows = language.predict(docs.select("doc_id", "text"), language.train(docs))
    return rows.select("doc_id", language.is_held_out().alias("held_out"), F.col("_lang.pred").alias("lang_pred"),
                       F.col("_lang.score").alias("score"), F.col("_lang.rejected").alias("rejected"))


@query
def op3_ngram_jaccard_join(spark, sf_dir):
    from acreage.llm import jaccard
    return jaccard.similar(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query
def op9_repeated_strings(spark, sf_dir):
    from acreage.llm import repeats
    rows = repeats.remove(table(spark, sf_dir, "documents").select("doc_id", "text"), length=400)
    n = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return rows.select("doc_id", n.alias("n_bytes"), (n - F.octet_length("_kept")).alias("n_removed"),
                       F.size("_spans").cast("long").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256"),
                       (F.size("_spans") > 0).alias("has_repeat"))


@query
def op11_periodic_runs(spark, sf_dir):
    from acreage.llm import periodic
    rows = periodic.detect(periodic.with_loop(table(spark, sf_dir, "documents")))
    rows = rows.withColumn("best", periodic.greatest(F.col("runs")))
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                       F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                       F.sha2(periodic.listed(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query
def op12_warc(spark, sf_dir):
    from acreage.llm import warc
    manifest = warc.write(table(spark, sf_dir, "pages"))
    return warc.records(manifest).select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                                         F.col("refers_to_page").cast("long").alias("refers_to"))


@query
def op13_filter_audit(spark, sf_dir):
    from acreage.llm import audit
    return audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
