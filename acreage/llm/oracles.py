"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from acreage.llm.quality import GAMMA, LEAST_VALUE, RATIOS
from acreage.llm.secrets import BASE, RULES

_WORD = r"[^\x20\x09-\x0D]+"
_BLANKS = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"

LINES = f"""
WITH lines AS (
  SELECT doc_id, source, i, raw, trim(raw, {_BLANKS}) AS line
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
), bad AS (
  SELECT line FROM lines WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 10
), marked AS (
  SELECT l.*, b.line IS NOT NULL AS gone FROM lines l LEFT JOIN bad b ON l.line = b.line
)
SELECT doc_id, count(*) FILTER (WHERE line <> '') AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
       sha256(coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATION = f"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_ITEM_WORD}') AS w FROM documents),
iw AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, regexp_extract_all({_LOWER}, '{_ITEM_WORD}') AS w FROM benchmark) WHERE len(w) > 0),
ip AS (SELECT item_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM iw),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM ip),
dp AS (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM dw, (SELECT DISTINCT n FROM win)),
hit AS (SELECT dp.doc_id, dp.i, dp.n, win.item_id FROM dp JOIN win ON dp.n = win.n AND array_to_string(dp.w[dp.i:dp.i + dp.n - 1], ' ') = win.s),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS j FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered ON dw.doc_id = covered.doc_id LEFT JOIN named ON dw.doc_id = named.doc_id
"""


def _either_case(regex: str) -> str:
    """The regex without its case flag: letters of the key words as classes of both cases (ASCII only)."""
    if not regex.startswith("(?i)"):
        return regex
    head, tail = regex[4:].split(")", 1)
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in head) + ")" + tail


def _secrets() -> str:
    parts = []
    for o, r in enumerate(RULES):
        regex = _either_case(r.regex).replace("'", "''")
        parts.append(f"""SELECT doc_id, {o} AS o, '{r.kind}' AS kind, unnest(generate_series(1, len(m))) AS i, m, g, v, {r.least} AS least
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{regex}') AS m, regexp_split_to_array(coalesce(text, ''), '{regex}') AS g,
               regexp_extract_all(coalesce(text, ''), '{regex}', {r.group}) AS v FROM documents) WHERE len(m) > 0""")
    return f"""
WITH found AS ({' UNION ALL '.join(parts)}),
spans AS (SELECT doc_id, o, kind, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a,
                 length(m[i]) AS n FROM found WHERE length(v[i]) >= least),
named AS (SELECT doc_id, o, CAST(a AS BIGINT) AS a, kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + n AS BIGINT) AS s, kind FROM spans),
per AS (SELECT doc_id, string_agg(s, ',' ORDER BY a, o) AS spans, string_agg(s, ',' ORDER BY a, o) FILTER (WHERE o < {len(BASE)}) AS base,
               {', '.join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in BASE)} FROM named GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN per ON d.doc_id = per.doc_id
"""


SECRETS = _secrets()


def _quality(reach: float = 3.0, least_rows: int = 100) -> str:
    share = {"symbols_per_word": ("n_symbols", "n_words"), "dup_line_share": ("n_dup_lines", "n_lines"),
             "repeat_word_share": ("n_repeat_words", "n_words"), "word_length": ("word_chars", "n_words")}
    ratios = ", ".join(f"CASE WHEN {b} > 0 THEN {a}::DOUBLE / {b}::DOUBLE ELSE 0.0 END AS {m}" for m, (a, b) in share.items())
    values = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {m} AS value FROM r WHERE NOT base_failed" for m in RATIOS)
    low = f"CAST(ceil(ln({LEAST_VALUE!r}::DOUBLE) / ln({GAMMA!r}::DOUBLE)) AS BIGINT)"
    least = " ".join(f"WHEN '{m}' THEN {s!r}::DOUBLE" for m, (s, _) in RATIOS.items())
    good = " AND ".join(f"{m} <= max(hi) FILTER (WHERE measure = '{m}')" + (f" AND {m} >= max(lo) FILTER (WHERE measure = '{m}')" if lower else "") for m, (_, lower) in RATIOS.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{_WORD}') AS w, list_filter(string_split(t, chr(10)), lambda x: trim(x, {_BLANKS}) <> '') AS l FROM d),
tri AS (SELECT k, i, count(*) OVER (PARTITION BY k, a, b, c) AS n FROM (SELECT k, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT k, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w))),
rep AS (SELECT k, count(DISTINCT j) AS n_repeat_words FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM tri WHERE n > 1) GROUP BY k),
m AS (SELECT w.k, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN rep ON w.k = rep.k),
r AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {ratios} FROM m),
v AS ({values}),
b AS (SELECT lang, source, measure, CASE WHEN value > {LEAST_VALUE!r}::DOUBLE THEN CAST(ceil(ln(value) / ln({GAMMA!r}::DOUBLE)) AS BIGINT) ELSE {low} END AS bin FROM v),
s AS (SELECT 0 AS level, lang, source, measure, bin, count(*) AS n FROM b GROUP BY ALL
      UNION ALL SELECT 1, lang, '', measure, bin, count(*) FROM b GROUP BY ALL
      UNION ALL SELECT 2, '', '', measure, bin, count(*) FROM b GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY level, lang, source, measure) AS total,
             CASE WHEN bin = {low} THEN 0.0 ELSE pow({GAMMA!r}::DOUBLE, bin::DOUBLE) * {2 / (GAMMA + 1)!r}::DOUBLE END AS value FROM s),
q AS (SELECT level, lang, source, measure, max(total) AS total, arg_min(value, bin) FILTER (WHERE upto >= floor(0.25 * (total - 1)) + 1) AS q25,
             arg_min(value, bin) FILTER (WHERE upto >= floor(0.75 * (total - 1)) + 1) AS q75 FROM c GROUP BY ALL),
f AS (SELECT level, lang, source, measure, total, q75 + {reach!r}::DOUBLE * greatest(q75 - q25, CASE measure {least} END) AS hi,
             q25 - {reach!r}::DOUBLE * greatest(q75 - q25, CASE measure {least} END) AS lo FROM q),
o AS (SELECT a.lang, a.source, a.measure, CASE WHEN a.total >= {least_rows} THEN a.hi WHEN l.total >= {least_rows} THEN l.hi ELSE e.hi END AS hi,
             CASE WHEN a.total >= {least_rows} THEN a.lo WHEN l.total >= {least_rows} THEN l.lo ELSE e.lo END AS lo
      FROM f a JOIN f l ON l.level = 1 AND l.lang = a.lang AND l.measure = a.measure JOIN f e ON e.level = 2 AND e.measure = a.measure WHERE a.level = 0)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(good, false) AS kept
FROM (SELECT r.k, doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, {good} AS good
      FROM r LEFT JOIN o ON r.lang = o.lang AND r.source = o.source
      GROUP BY r.k, doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, {', '.join(RATIOS)})
"""


QUALITY = _quality()


PERIODIC = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
                  xor(4294967295, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
                    lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295)) AS h
           FROM documents),
g AS (SELECT *, CAST(len(w) AS BIGINT) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM g),
t AS (SELECT k, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(generate_series(0, n - 1), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS w FROM p),
f AS MATERIALIZED (SELECT k, n, i, w[i + 1] AS x, array_to_string(w[i + 1:i + 5], ' ') AS gram FROM (SELECT k, n, w, unnest(generate_series(0, n - 1)) AS i FROM t)),
l AS (SELECT DISTINCT a.k, a.n, b.i - a.i AS q FROM f a JOIN f b ON a.k = b.k AND a.gram = b.gram AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
e AS (SELECT l.k, q, a.i, a.i - row_number() OVER (PARTITION BY l.k, q ORDER BY a.i) AS island
      FROM l JOIN f a ON a.k = l.k JOIN f b ON b.k = l.k AND b.i = a.i + l.q AND b.x = a.x),
s AS (SELECT k, q, min(i) AS start, count(*) + q AS length FROM e GROUP BY k, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.k = s.k AND o.q < s.q AND o.start <= s.start AND o.start + o.length >= s.start + s.length)),
b AS (SELECT k, count(*) AS n_runs, arg_min({{'s': start, 'l': length, 'p': q}}, [-length, start, q]) AS best,
             string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS listed FROM r GROUP BY k),
c AS (SELECT DISTINCT k, unnest(generate_series(start + q, start + length - 1)) AS i FROM r),
x AS (SELECT f.k, string_agg(f.x, ' ' ORDER BY f.i) AS kept FROM f LEFT JOIN c ON c.k = f.k AND c.i = f.i WHERE c.i IS NULL GROUP BY f.k)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(best.s AS BIGINT) AS start, CAST(best.l AS BIGINT) AS length, CAST(best.p AS BIGINT) AS period,
       CAST(1000 * best.l // best.p AS BIGINT) AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN b ON t.k = b.k LEFT JOIN x ON t.k = x.k
"""

WARC = """
SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
       CASE WHEN least_id < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN least_id < page_id THEN least_id END AS refers_to
FROM (SELECT *, CASE WHEN octet_length(encode(html)) >= 100 THEN min(page_id) OVER (PARTITION BY html) END AS least_id FROM pages)
"""

AUDIT = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT)
                 + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS INT) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
                 + 16 * CAST(coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false) AS INT) AS mask, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
      FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
g AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM f a, f b, f c, f d, f e
      WHERE len(list_distinct([a.b, b.b, c.b, d.b, e.b])) = 5),
s AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step, unnest(bits) AS bit, unnest([0, bits[1], bits[1] + bits[2], bits[1] + bits[2] + bits[3], 31 - bits[5]]) AS before FROM o)
SELECT part, filter_order, step, CAST(coalesce(sum(n) FILTER (WHERE mask & (before | bit) = 0), 0) AS BIGINT) AS kept,
       CAST(coalesce(sum(n) FILTER (WHERE mask & (before | bit) = bit), 0) AS BIGINT) AS removed,
       CAST(coalesce(sum(n) FILTER (WHERE mask & bit > 0 AND mask & before > 0), 0) AS BIGINT) AS redundant,
       CAST(coalesce(sum(n) FILTER (WHERE mask = bit), 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(sum(good) FILTER (WHERE mask & (before | bit) = bit), 0) AS BIGINT) AS good_lost,
       CAST(coalesce(sum(toxic) FILTER (WHERE mask & (before | bit) = bit), 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(sum(n * (120 // nullif(bit_count(mask::INT), 0))) FILTER (WHERE mask & bit > 0), 0) AS BIGINT) AS shapley
FROM g, s GROUP BY part, filter_order, step
"""
