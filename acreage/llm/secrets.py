"""Operator 4 (native): secret scans with a trigram inverted index.

From each rule's regex a Boolean trigram query is derived: an AND of clauses, each an
OR of strings, each the AND of its trigrams.  The index holds a posting (trigram,
document) for every trigram that some rule names.  Postings are intersected by
aggregation, documents that satisfy a rule's query are its candidates, and the regex
runs on these alone.  A rule without mandatory trigrams runs on every text.  The index
is of lower-cased texts, so it serves rules in either case.

Spans count code points, end exclusive.  A match's place is the length of the gaps
(the text split at the matches) and matches before it.

Defined results: null text counts as empty and has no spans; a null key is kept;
repeated rows and equal keys are scanned row by row; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``group``: the group whose length must be at least ``least`` (0: the whole match)."""
    kind: str
    regex: str
    group: int = 0
    least: int = 0


# fixed values: the first three are the base rules, in their order
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
)
RULES = BASE + MORE
MOST_STRINGS = 64          # alternatives that are followed side by side; beyond, the clause ends there


def trigram_query(regex: str) -> list[list[frozenset[str]]]:
    """AND of ORs of trigram sets that every match must satisfy (empty: no mandatory trigram)."""
    clauses: list[list[frozenset[str]]] = []

    def finish(strings: set[str]) -> set[str]:
        if strings and all(len(s) >= 3 for s in strings):
            sets = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings}
            clauses.append(sorted((x for x in sets if not any(y < x for y in sets)), key=sorted))   # a superset adds nothing
        return {""}

    def exact(items) -> set[str] | None:
        """All strings that the items match, if these are few."""
        found = {""}
        for op, arg in items:
            if op is C.LITERAL:
                more = {chr(arg).lower()}
            elif op is C.IN and all(o is C.LITERAL for o, _ in arg):
                more = {chr(a).lower() for _, a in arg}
            elif op is C.SUBPATTERN:
                more = exact(arg[3])
            elif op is C.BRANCH:
                parts = [exact(b) for b in arg[1]]
                more = None if None in parts else set().union(*parts)
            elif op is C.MAX_REPEAT and arg[1] is not C.MAXREPEAT and arg[1] <= 4:
                one = exact(arg[2])
                more = None if one is None else {"".join(p) for k in range(arg[0], arg[1] + 1) for p in product(one, repeat=k)}
            else:
                more = None
            if more is None or len(found) * len(more) > MOST_STRINGS:
                return None
            found = {a + b for a in found for b in more}
        return found

    def walk(items, strings: set[str]) -> set[str]:
        for item in items:
            more = exact([item])
            if more is not None and len(strings) * len(more) <= MOST_STRINGS:
                strings = {a + b for a in strings for b in more}
                continue
            strings = finish(strings)
            op, arg = item
            if more is not None:
                strings = more
            elif op is C.SUBPATTERN:
                strings = walk(arg[3], strings)
            elif op is C.MAX_REPEAT and arg[0] >= 1:
                walked = walk(arg[2], {""})
                finish(walked)
                strings = {""}
        return strings

    finish(walk(_parser.parse(regex), {""}))
    return clauses


def index(docs: DataFrame, rules=RULES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Postings (trigram, key) of all trigrams that the rules' queries name."""
    grams = sorted({g for r in rules for clause in trigram_query(r.regex) for s in clause for g in s})
    rows = docs.select(F.col(key).alias("doc_id"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("low"))
    found = [F.when(F.contains(F.col("low"), F.lit(g)), F.lit(g)) for g in grams]
    return rows.select("doc_id", F.explode(F.array_compact(F.array(*found))).alias("trigram")) if grams else \
        rows.select("doc_id", F.lit("").alias("trigram")).limit(0)


def _literal(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def candidates(postings: DataFrame, rules=RULES) -> DataFrame:
    """(doc_id, kinds): documents that satisfy the trigram queries of these rules."""
    queries = {r.kind: trigram_query(r.regex) for r in rules}
    rows = [(kind, c, a, len(grams), g) for kind, clauses in queries.items() for c, strings in enumerate(clauses)
            for a, grams in enumerate(strings) for g in sorted(grams)]
    values = ", ".join(f"({_literal(k)}, {c}, {a}, {n}, {_literal(g)})" for k, c, a, n, g in rows) or "('', 0, 0, 1, '')"
    named = postings.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t(kind, clause, string, size, trigram)")
    need = F.create_map(*[x for k, clauses in queries.items() for x in (F.lit(k), F.lit(len(clauses)))])
    hits = (postings.join(F.broadcast(named), "trigram")          # as many rows as the rules have trigrams
            .groupBy("doc_id", "kind", "clause", "string").agg(F.count_distinct("trigram").alias("n"), F.first("size").alias("size"))
            .where(F.col("n") == F.col("size")))
    return (hits.groupBy("doc_id", "kind").agg(F.count_distinct("clause").alias("clauses"))
            .where(F.col("clauses") == need[F.col("kind")])
            .groupBy("doc_id").agg(F.collect_set("kind").alias("kinds")))


def rule_spans(text: str, rule: Rule, order: int) -> Column:
    """Spans of a rule's matches in a text column: array of (start, order, end, kind)."""
    regex = _literal(rule.regex)
    parts = f"struct(regexp_extract_all({text}, {regex}, 0) as m, split({text}, {regex}, -1) as g, regexp_extract_all({text}, {regex}, {rule.group}) as v)"
    walk = (f"aggregate(sequence(0, size(p.m) - 1), struct(0 as at, cast(array() as array<struct<start:int,o:int,stop:int,kind:string>>) as s), "
            f"(a, i) -> struct(a.at + length(p.g[i]) + length(p.m[i]) as at, "
            f"case when length(p.v[i]) >= {rule.least} then concat(a.s, array(struct(a.at + length(p.g[i]) as start, {order} as o, a.at + length(p.g[i]) + length(p.m[i]) as stop, '{rule.kind}' as kind))) else a.s end as s)).s")
    return F.expr(f"transform(array({parts}), p -> {walk})[0]")


def scan(docs: DataFrame, rules=RULES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: doc_id and spans, an array of (start, order, stop, kind) sorted by start, then kind as listed."""
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = candidates(index(docs, rules, text, key), rules).withColumnRenamed("doc_id", "hit_id")
    rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col("hit_id")), "left")
    none = F.expr("cast(array() as array<struct<start:int,o:int,stop:int,kind:string>>)")
    spans = []
    for order, r in enumerate(rules):
        sieve = F.array_contains(F.coalesce("kinds", F.array().cast("array<string>")), r.kind) if trigram_query(r.regex) else F.lit(True)
        spans.append(F.when(sieve & F.col("text").rlike(r.regex), rule_spans("text", r, order)).otherwise(none))
    return rows.select("doc_id", F.array_sort(F.concat(*spans)).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
