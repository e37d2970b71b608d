"""Tokens and character n-grams as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Any caller may tokenise in a way of its own: a function from a text column to an array of terms.
Tokenizer = Callable[[Column], Column]


def whitespace_tokens(text: Column) -> Column:
    """Terms between Unicode white space, as they stand; null counts as an empty text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda t: t != "")


def char_grams(term: Column, k: int) -> Column:
    """The distinct stretches of ``k`` characters of a term; none if it is shorter."""
    starts = F.sequence(F.lit(1), F.char_length(term) - (k - 1))
    return F.when(F.char_length(term) >= k, F.array_distinct(F.transform(starts, lambda i: term.substr(i, F.lit(k))))).otherwise(
        F.array().cast("array<string>")
    )
