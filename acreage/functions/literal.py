"""Python-literal text to JSON text, in column expressions (inventory A4).

The text is cut into tokens by one regular expression; each token is rewritten by itself, with a look at its
neighbours, and the tokens are joined.  What the grammar covers: lists, tuples, dicts, None, True, False, numbers
(signs, underscores, hexadecimal, octal and binary, ``1.`` and ``.5``), strings in either quote or three of them,
raw and ``u`` strings, all escapes but ``\\N{...}``, strings side by side, trailing commas, one value in brackets.
JSON texts are read too.  Not covered, and counted as bad by ``is_bad_literal``: sets, bytes, complex numbers,
tuples without brackets, ``\\N{...}``.  Keys of dicts become texts (``{1: 'a'}`` has the key ``1``).

All quantifiers over characters are possessive: long strings neither recurse nor backtrack.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STRING = (r"""[uUrR]?(?:'''(?:[^'\\]++|\\.|'(?!''))*+'''|\"\"\"(?:[^"\\]++|\\.|"(?!""))*+\"\"\"|"""
          r"""'(?:[^'\\\n]++|\\.)*+'|"(?:[^"\\\n]++|\\.)*+")""")
NUMBER = r"(?:[-+]\s*+)?(?:0[xX][0-9a-fA-F_]++|0[oO][0-7_]++|0[bB][01_]++|(?:\d[\d_]*+\.?[\d_]*+|\.\d[\d_]*+)(?:[eE][-+]?\d[\d_]*+)?)(?!\w)"
TOKEN = rf"(?s){STRING}|{NUMBER}|[A-Za-z_]\w*+|\S"
PIECE = r"""(?s)\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\U[0-9a-fA-F]{8}|\\[0-7]{1,3}|\\.|[\x00-\x1f"]|[^\\"\x00-\x1f]++"""
BAD = "\u0001"                         # control characters are escaped, so no rewritten token holds it


def bind(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def _hex4(code: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code.cast("long"))), 4, "0"))


def _number_of(digits: Column, base: int) -> Column:
    return F.conv(digits, base, 10).try_cast("long")


def _piece(x: Column) -> Column:
    """One escape, quote, control character or run of others, as it stands in a JSON string."""
    c, size = F.substring(x, 2, 1), F.length(x)

    def wide(code):
        high, low = F.lit(0xD800) + F.shiftright(code - 0x10000, 10), F.lit(0xDC00) + code.bitwiseAND(F.lit(0x3FF))
        return F.when(code < 0x10000, _hex4(code)).when(code <= 0x10FFFF, F.concat(_hex4(high), _hex4(low))).otherwise(F.lit(BAD))

    escape = (F.when((c == "x") & (size == 4), F.concat(F.lit("\\u00"), F.substring(x, 3, 2)))
              .when((c == "u") & (size == 6), x)
              .when((c == "U") & (size == 10), wide(_number_of(F.substring(x, 3, 8), 16)))
              .when(c.rlike("[0-7]"), _hex4(_number_of(F.substring(x, 2, 3), 8)))
              .when(c.isin("n", "t", "r", "b", "f", '"', "\\"), x)
              .when(c == "a", F.lit("\\u0007")).when(c == "v", F.lit("\\u000b"))
              .when(c == "'", c).when(c == "\n", F.lit(""))
              .when(c.isin("x", "u", "U", "N"), F.lit(BAD))
              .otherwise(F.concat(F.lit("\\\\"), c)))
    return (F.when(x.startswith("\\"), escape).when(x == '"', F.lit('\\"'))
            .when((size == 1) & (F.ascii(x) < 32), _hex4(F.ascii(x))).otherwise(x))


def _inner(x: Column) -> Column:
    """The inside of a string token, escaped for JSON."""
    raw, tail = x.rlike("^[rR]"), F.regexp_replace(x, "^[uUrR]", "")
    three = tail.rlike("^('''|\"\"\")") & (F.length(tail) >= 6)
    edge = F.when(three, 3).otherwise(1)
    inside = F.substring(tail, edge + 1, F.length(tail) - 2 * edge)
    # in a raw string a backslash is a character; its quotes are left to the pieces below
    inside = F.when(raw, F.replace(inside, F.lit("\\"), F.lit("\\\\"))).otherwise(inside)
    pieces = bind(inside, lambda t: F.when(~t.rlike(r'[\\"\x00-\x1f]'), t).otherwise(
        F.array_join(F.transform(F.regexp_extract_all(t, F.lit(PIECE), 0), _piece), "")))
    return pieces


def _number(x: Column) -> Column:
    text = F.regexp_replace(x, r"[\s_+](?<![eE]\+)", "")
    minus = F.when(text.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    digits = F.regexp_replace(text, "^-", "")
    mark = F.lower(F.substring(digits, 1, 2))
    based = lambda base: F.coalesce(F.concat(minus, _number_of(F.substring(digits, 3, 70), base).cast("string")), F.lit(BAD))
    point = F.regexp_replace(F.regexp_replace(digits, r"^\.", "0."), r"\.(?!\d)", ".0")
    wrong = x.rlike(r"__|_(?!\w)|[._]_|_\.")
    return (F.when(wrong | ~x.rlike(r"\d"), F.lit(BAD)).when(mark == "0x", based(16)).when(mark == "0o", based(8)).when(mark == "0b", based(2))
            .otherwise(F.concat(minus, F.regexp_replace(point, r"^0+(?=0(\D|$)|\d+[.eE])", ""))))


def to_json_text(c: Column) -> Column:
    """JSON text of a Python-literal text; what is no literal gives a text that no JSON reader takes."""

    def is_string(x):
        return F.coalesce(x.rlike("""^[uUrR]?['"]""") & (F.length(x) > 1), F.lit(False))

    def rewrite(tokens):
        def one(x, i):
            after, before = F.get(tokens, i + 1), F.when(i > 0, F.get(tokens, i - 1))
            key = F.coalesce(after == ":", F.lit(False))
            quote = F.when(key, F.lit('"')).otherwise(F.lit(""))
            lone = lambda inside: F.coalesce(~inside.rlike(r"^[\[\](){},:]$"), F.lit(False))
            opens = (x == "(") & (F.get(tokens, i + 2) == ")") & lone(after)
            closes = (x == ")") & F.when(i > 1, F.get(tokens, i - 2) == "(").otherwise(False) & lone(before)
            text = F.concat(F.when(is_string(before), F.lit("")).otherwise(F.lit('"')), _inner(x), F.when(is_string(after), F.lit("")).otherwise(F.lit('"')))
            return (F.when(is_string(x), text)
                    .when(opens | closes, F.lit(""))
                    .when((x == ",") & after.rlike(r"^[\])}]$") & lone(before), F.lit(""))
                    .when((x == ",") & after.rlike(r"^[\])}]$") & before.rlike(r"^[\])}]$"), F.lit(""))
                    .when(x == "(", F.lit("[")).when(x == ")", F.lit("]"))
                    .when(x.rlike(r"^[\[\]{},:]$"), x)
                    .when(x.rlike(r"^[-+.\d]"), F.concat(F.lit(" "), quote, _number(x), quote, F.lit(" ")))
                    .when(x.isin("None", "True", "False"), F.when(key, F.concat(quote, x, quote)).when(x == "None", F.lit(" null ")).otherwise(F.concat(F.lit(" "), F.lower(x), F.lit(" "))))
                    .when(x.isin("null", "true", "false") & ~key, F.concat(F.lit(" "), x, F.lit(" ")))
                    .otherwise(F.lit(BAD)))
        return F.array_join(F.transform(tokens, one), "")

    def paired(tokens):
        """Whether each bracket meets its own kind; the open ones are kept in a text."""
        brackets = F.filter(tokens, lambda x: x.rlike(r"^[\[\](){}]$"))
        mate = lambda x: F.when(x == ")", F.lit("(")).when(x == "]", F.lit("[")).otherwise(F.lit("{"))
        left = F.aggregate(brackets, F.lit(""), lambda open_, x: F.when(x.isin("(", "[", "{"), F.concat(open_, x))
                           .when(F.right(open_, F.lit(1)) == mate(x), F.substring(open_, F.lit(1), F.length(open_) - 1)).otherwise(F.concat(F.lit("!"), open_, F.lit("!"))))
        return left == ""

    text = bind(F.regexp_extract_all(c, F.lit(TOKEN), 0), lambda t: F.when(paired(t), rewrite(t)).otherwise(F.lit(BAD)))
    # readers of JSON stop after the first value: as the one element of an array the text is read to its end
    return bind(text, lambda j: F.when(~j.contains(BAD) & (F.json_array_length(F.concat(F.lit("["), j, F.lit("]"))) == 1), j).otherwise(F.lit(BAD)))


def is_bad_literal(c) -> Column:
    """Whether a text that is neither null nor blank is no literal of the grammar above."""
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce((F.btrim(col) != "") & (to_json_text(col) == BAD), F.lit(False))
