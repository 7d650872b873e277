"""Scalar text functions, all Column -> Column and all JVM-side."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The code points with the Unicode White_Space property.
WHITE_SPACE = (
    "\t\n\v\f\r \u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
QUOTES = ('"', "'", "`")


def inline_once(df: DataFrame, kept: Sequence[str | Column], structs: Column) -> DataFrame:
    """One row per struct of an array column.

    A plain ``inline`` makes the optimizer add a filter on the size of the array,
    which evaluates the array a second and a third time. The outer form does
    not; the row it gives for an empty array is dropped by its marker.
    """
    marked = F.transform(structs, lambda s: F.struct(F.lit(True).alias("_found"), s.alias("_row")))
    rows = df.select(*kept, F.inline_outer(marked)).filter(F.col("_found"))
    names = [f.name for f in rows.schema["_row"].dataType]
    columns = [c for c in rows.columns if c not in ("_found", "_row")]
    return rows.select(*columns, *[F.col("_row")[n].alias(n) for n in names])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it in ``body``.

    A plain Column used twice is evaluated twice when Catalyst inlines it into
    a lambda; binding it as a lambda variable cannot be inlined.
    """
    return F.transform(F.array(value), body)[0]


def trim_space(s: Column) -> Column:
    """Strip Unicode white space from both ends (``trim`` strips only U+0020)."""
    return F.btrim(s, F.lit(WHITE_SPACE))


def newlines(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))


def trim_quotes_code(s: Column) -> Column:
    """Drop one pair of equal surrounding quotes; no space trimming."""
    first, last = F.left(s, F.lit(1)), F.right(s, F.lit(1))
    quoted = (F.length(s) >= 2) & (first == last) & first.isin(*QUOTES)
    return F.when(quoted, F.substring(s, F.lit(2), F.length(s) - 2)).otherwise(s)


def trim_quotes_env(s: Column) -> Column:
    return trim_quotes_code(trim_space(s))


# Anchored at the first quote: when that one is never closed there is no literal.
_FIRST_LITERAL = r"""(?s)^[^"'`]*+(["'`])(.*?)\1"""


def first_string(expr: Column) -> Column:
    """Text of the first quoted literal in an expression, or ''."""
    return F.regexp_extract(expr, _FIRST_LITERAL, 2)


def last_string(expr: Column) -> Column:
    """Text of the last quoted literal in an expression, or ''."""
    return F.reverse(F.regexp_extract(F.reverse(expr), _FIRST_LITERAL, 2))


def _byte_as_char(raw: Column, pos: Column) -> Column:
    return F.chr(F.conv(F.hex(F.substring(raw, pos, F.lit(1))), 16, 10).cast("bigint"))


def redact_value(value: Column) -> Column:
    """Redact by byte length; only short plain values keep their outer bytes."""
    size = F.octet_length(value)
    raw = value.cast("binary")
    return (
        F.when(size == 0, F.lit('""'))
        .when(size > 20, F.lit("[REDACTED]"))
        .when((size > 10) & value.rlike("[=+/]"), F.lit("[REDACTED]"))
        .when(size > 4, F.concat(_byte_as_char(raw, F.lit(1)), F.lit("..."), _byte_as_char(raw, size)))
        .otherwise(F.lit("***"))
    )


def truncate_snippet(snippet: Column) -> Column:
    """Over 80 bytes: the first 77 bytes and '...'; a split character shows as U+FFFD."""
    head = F.substring(snippet.cast("binary"), F.lit(1), F.lit(77)).cast("string")
    return F.when(F.octet_length(snippet) > 80, F.concat(F.make_valid_utf8(head), F.lit("..."))).otherwise(snippet)


def format_location(file: Column, line: Column, snippet: Column) -> Column:
    """``file:line``, with `` (snippet)`` when there is one."""
    place = F.concat(file, F.lit(":"), line.cast("string"))
    return F.when(snippet != "", F.concat(place, F.lit(" ("), snippet, F.lit(")"))).otherwise(place)


_BASE64 = r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"


def decode_base64(value: Column) -> Column:
    """Padded standard base64 as text; anything else unchanged."""
    packed = F.translate(value, "\r\n", "")
    return F.when(packed.rlike(_BASE64), F.unbase64(packed).cast("string")).otherwise(value)
