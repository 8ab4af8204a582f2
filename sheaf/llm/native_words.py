"""Words as Column expressions, for operators that stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def letter_words(text: Column) -> Column:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text with A-Z lower-cased; none for null.

    ``lower`` also changes letters outside ASCII, so it serves whole texts only
    where there are none, and elsewhere tells which words need a look at all.
    """
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    split = F.split(F.when(plain, F.lower(text)).otherwise(text), _BETWEEN)
    words = F.when(plain, split).otherwise(F.transform(split, lambda w: F.when(F.lower(w) == w, w).otherwise(F.translate(w, _UPPER, _UPPER.lower()))))
    return F.array_remove(words, "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once.

    A column that stands inside a lambda would be inlined there by the optimiser
    and evaluated for each element; a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
