"""Token columns (C29, A1, A3): the analysis of a ranked field."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from codequarry.functions.text import bind

# Fixed value: tokens are separated by line breaks, Unicode space and punctuation.
SEPARATORS = r"[\n\r\p{Z}\p{P}]+"


def tokens(text: Column, among: Callable[[Column], Column] | None = None) -> Column:
    """Lower-cased non-empty tokens, duplicates kept; only those ``among`` the wanted where a test is given."""
    return F.filter(F.split(F.lower(text), SEPARATORS, -1), lambda t: t != "" if among is None else (t != "") & among(t))


def field_length(text: Column) -> Column:
    """A3: distinct raw tokens, where an empty string counts as one token."""
    return F.size(F.array_distinct(F.split(text, SEPARATORS, -1)))


def term_counts(token_array: Column) -> Column:
    """A1: ``array<struct<term,tf>>`` of a token array, in term order.

    Sorted, equal tokens are neighbours and term frequencies are run lengths:
    the row is counted in place and no token is ever shuffled.
    """
    def counted(ordered: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(ordered) - 1),
            lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)),
        )
        runs = bind(starts, lambda s: F.transform(s, lambda at, j: F.struct(
            F.get(ordered, at).alias("term"),
            (F.coalesce(F.get(s, j + 1), F.size(ordered)) - at).alias("tf"),
        )))
        return F.when(F.size(ordered) > 0, runs).otherwise(
            F.array().cast("array<struct<term:string,tf:int>>")
        )

    return bind(F.sort_array(token_array), counted)
