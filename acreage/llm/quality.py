"""Operator 7 (native): quality rules with adaptive thresholds.

Every text is measured in one pass of DataFrame expressions; the measures are stored,
so that texts are read once.  The thresholds come from mergeable quantile sketches:
a sketch is the count of values in each bin of a logarithmic scale (bins of 1 %
relative width), kept per language and source; sketches merge by adding counts, so
they are built with map-side sums, are the same under any partitioning, and the
sketch of a language is the sum of those of its sources.  A document is kept when each
ratio is at most q75 + reach * max(q75 - q25, least spread) of its language and
source, and its mean word length also at least q25 - the same.  Groups with fewer than
``least_rows`` rows use the sketch of their language, and a language with fewer the
sketch of all rows.  Rows that fail the base rules are not part of the sketches.

Windows of three words are compared by 64-bit hashes of their words.

Defined results: null and empty texts have no words, fail the base rule and are not
kept; null languages and sources count as the empty string; each repeated row is
judged by itself; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acreage.llm.common import stored
from acreage.operators.scalars import attach_row

BLANKS = "[ \\t\\n\\u000B\\f\\r]+"
BLANK_CHARS = " \t\n\u000b\f\r"
SYMBOLS = "#*$%&|<>"
ACCURACY = 0.01
GAMMA = (1 + ACCURACY) / (1 - ACCURACY)
LEAST_VALUE = 1e-6                      # smaller values share the lowest bin
# measure -> (least spread, is there a lower threshold too).  A least spread keeps groups
# without variation from rejecting ordinary rows: three times it is about the cutoff of
# published rule sets (0.1 symbols a word, 0.3 of lines, 0.2 of words, 1 character).
RATIOS = {"symbols_per_word": (0.033, False), "dup_line_share": (0.1, False),
          "repeat_word_share": (0.067, False), "word_length": (0.33, True)}


def measures(docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", source: str = "source") -> DataFrame:
    """Counts of each text: words, their characters, symbols, repeated lines, repeated words."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(lang), F.lit("")).alias("lang"),
                       F.coalesce(F.col(source), F.lit("")).alias("source"), t.alias("text"))
    rows = rows.select(
        "doc_id", "lang", "source",
        F.filter(F.split("text", BLANKS), lambda w: w != "").alias("words"),
        F.length(F.translate("text", BLANK_CHARS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANK_CHARS)) != "").alias("lines"))
    narrow = ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    rows = rows.withColumns({
        "n_words": F.size("words").cast("long"), "n_lines": F.size("lines").cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "windows": F.expr("case when size(words) >= 3 then transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2])) else array() end")})
    rows = rows.select(*narrow, F.when(F.size(F.array_distinct("windows")) < F.size("windows"),
                                       F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("sorted"))
    rows = rows.select(*narrow, F.expr("sort_array(transform(filter(sorted, (x, j) -> coalesce(get(sorted, j - 1).h = x.h, false) or coalesce(get(sorted, j + 1).h = x.h, false)), x -> x.i))").alias("twice"))
    return rows.select(*narrow, F.expr("coalesce(aggregate(transform(twice, (x, j) -> least(3, coalesce(get(twice, j + 1) - x, 3))), 0L, (a, x) -> a + x), 0L)").alias("n_repeat_words"))


def with_ratios(rows: DataFrame) -> DataFrame:
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return rows.withColumns({
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        "symbols_per_word": share("n_symbols", "n_words"), "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_word_share": share("n_repeat_words", "n_words"), "word_length": share("word_chars", "n_words")})


def sketches(rows: DataFrame) -> DataFrame:
    """(level, lang, source, measure, bin, n): level 0 of a language and source, 1 of a language, 2 of all."""
    low = F.lit(math.ceil(math.log(LEAST_VALUE) / math.log(GAMMA)))
    scale = F.ceil(F.log(F.col("value")) / F.lit(math.log(GAMMA)))
    long = (rows.where(~F.col("base_failed"))
            .select("lang", "source", F.explode(F.create_map(*[x for m in RATIOS for x in (F.lit(m), F.col(m))])).alias("measure", "value"))
            .withColumn("bin", F.when(F.col("value") > LEAST_VALUE, scale).otherwise(low).cast("long"))
            .groupBy("lang", "source", "measure", "bin").agg(F.count("*").alias("n")))
    level = long.select(F.lit(0).alias("level"), "lang", "source", "measure", "bin", "n")
    langs = long.groupBy("lang", "measure", "bin").agg(F.sum("n").alias("n")).select(F.lit(1).alias("level"), "lang", F.lit("").alias("source"), "measure", "bin", "n")
    every = long.groupBy("measure", "bin").agg(F.sum("n").alias("n")).select(F.lit(2).alias("level"), F.lit("").alias("lang"), F.lit("").alias("source"), "measure", "bin", "n")
    return level.unionByName(langs).unionByName(every)


def quantiles(sketch: DataFrame, qs: tuple[float, ...] = (0.25, 0.75)) -> DataFrame:
    """Quantiles of each sketch, within the accuracy of its bins, and its number of rows."""
    keys = ["level", "lang", "source", "measure"]
    w = Window.partitionBy(*keys)
    low = math.ceil(math.log(LEAST_VALUE) / math.log(GAMMA))
    value = F.when(F.col("bin") == low, 0.0).otherwise(F.pow(F.lit(GAMMA), F.col("bin").cast("double")) * (2 / (GAMMA + 1)))
    rows = sketch.withColumns({"upto": F.sum("n").over(w.orderBy("bin")), "rows": F.sum("n").over(w), "value": value})
    return rows.groupBy(*keys).agg(F.first("rows").alias("rows"), *[
        F.min(F.when(F.col("upto") >= F.floor(q * (F.col("rows") - 1)) + 1, F.struct("bin", "value"))).getField("value").alias(f"q{int(100 * q)}") for q in qs])


def thresholds(rows: DataFrame, reach: float = 3.0, least_rows: int = 100) -> DataFrame:
    """One row for each language and source: the upper and lower threshold of each measure."""
    q = stored(quantiles(sketches(rows)), "quantiles")
    spread = F.col("q75") - F.col("q25")
    least = F.create_map(*[x for m, (s, _) in RATIOS.items() for x in (F.lit(m), F.lit(s))])[F.col("measure")]
    reach_by = reach * F.greatest(spread, least)
    q = q.select("level", "lang", "source", "measure", "rows", (F.col("q75") + reach_by).alias("hi"), (F.col("q25") - reach_by).alias("lo"))
    wide = [F.max(F.when(F.col("measure") == m, F.col(x))).alias(f"{x}_{m}") for m in RATIOS for x in ("hi", "lo")]
    level = lambda n, keys: q.where(F.col("level") == n).groupBy(*keys).agg(F.max("rows").alias("rows"), F.struct(*wide).alias("limits"))
    own, of_lang = level(0, ["lang", "source"]), level(1, ["lang"]).withColumnsRenamed({"rows": "lang_rows", "limits": "lang_limits"})
    every = q.where(F.col("level") == 2).agg(F.struct(*wide).alias("all_limits"))          # one row
    return (attach_row(own.join(of_lang, "lang"), every)
            .select("lang", "source", F.when(F.col("rows") >= least_rows, F.col("limits"))
                    .when(F.col("lang_rows") >= least_rows, F.col("lang_limits")).otherwise(F.col("all_limits")).alias("limits")))


def judge(docs: DataFrame, reach: float = 3.0, least_rows: int = 100, **names: str) -> DataFrame:
    """Measures and verdict of every document."""
    rows = with_ratios(stored(measures(docs, **names), "measures"))
    limits = thresholds(rows, reach, least_rows)
    good = F.lit(True)
    for m, (_, lower) in RATIOS.items():
        good = good & (F.col(m) <= F.col(f"limits.hi_{m}"))
        if lower:
            good = good & (F.col(m) >= F.col(f"limits.lo_{m}"))
    return (rows.join(limits, ["lang", "source"], "left")
            .withColumn("kept", ~F.col("base_failed") & F.coalesce(good, F.lit(False))).drop("limits"))
