"""Text columns: decoding, line splitting, trimming, truncation, counting.

Everything here is a native Column expression, so it stays in the JVM and can
be used both on table columns and on lambda variables of ``transform``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters ECMAScript's String.prototype.trim removes.
TRIM_CHARS = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def decode_utf8(content: Column) -> Column:
    """Bytes to text, replacing malformed sequences by U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def lf(text: Column) -> Column:
    """CRLF to LF."""
    return F.replace(text, F.lit("\r\n"), F.lit("\n"))


def split_lines(text: Column) -> Column:
    """S3: lines of LF text; a final empty line is kept."""
    return F.split(text, "\n", -1)


def line_count(text: Column) -> Column:
    """Number of lines, without building the line array."""
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("int")


def js_trim(text: Column) -> Column:
    """C4: trim all Unicode white space and the BOM from both ends."""
    return F.btrim(text, F.lit(TRIM_CHARS))


def truncate(text: Column, n: int | None) -> Column:
    """At most ``n`` characters, marked with an ellipsis when cut; ``None`` keeps all."""
    if n is None:
        return text
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def first_of(items: Column, n: int | None) -> Column:
    """The first ``n`` elements of an array; ``None`` keeps all."""
    return items if n is None else F.slice(items, 1, n)


def occurrences(text: Column, target: Column) -> Column:
    """Non-overlapping occurrences of a non-empty literal target."""
    removed = F.length(text) - F.length(F.replace(text, target, F.lit("")))
    return (removed / F.length(target)).cast("int")


def replace_first(text: Column, target: Column, replacement: Column) -> Column:
    """Replace the first literal occurrence."""
    at = F.position(target, text)
    return F.when(at > 0, F.overlay(text, replacement, at, F.length(target))).otherwise(text)


def has_nul(content: Column) -> Column:
    """A NUL byte within the first 512 bytes of a BINARY column."""
    return F.position(F.lit(b"\x00"), F.substring(content, 1, 512)) > 0
