"""Trigram sets and their Jaccard similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trigrams(text: Column) -> Column:
    """Distinct trigrams of each lower-cased word, padded by two blanks and one."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    per_word = F.transform(words, lambda w: F.transform(
        F.sequence(F.lit(1), F.length(w) + 1),
        lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(per_word))


def jaccard(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(shared, F.size(a) + F.size(b) - shared), F.lit(0.0))


def codes(grams: Column) -> Column:
    """Trigrams as numbers, 21 bits a character: equal where the trigrams are, and quicker to compare."""
    def bits(t: Column, i: int) -> Column:
        return F.ascii(F.substring(t, i, 1)).cast("bigint")

    return F.transform(grams, lambda t: F.shiftleft(F.shiftleft(bits(t, 1), 21) + bits(t, 2), 21) + bits(t, 3))
