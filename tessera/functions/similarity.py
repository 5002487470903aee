"""Similarities in column expressions: trigrams, vectors, lexical scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import fold_accents


def trigrams(c: Column) -> Column:
    """Distinct trigrams of each word, padded with two blanks before it and one after."""
    words = F.filter(F.split(F.lower(fold_accents(c)), "[^a-z0-9]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substr(w, i, F.lit(3))))))


def overlap(a: Column, b: Column) -> Column:
    """Shared over all elements of two sets."""
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) > 0, both / (F.size(a) + F.size(b) - both)).otherwise(0.0)


def coverage(query: Column, candidate: Column) -> Column:
    """The share of a query's distinct words that a candidate has; 1 without words."""
    q, c = (F.array_distinct(F.filter(F.split(F.lower(x), "(?U)\\s+"), lambda w: w != "")) for x in (query, candidate))
    return F.when(F.size(q) == 0, 1.0).otherwise(F.size(F.array_intersect(q, c)) / F.size(q))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def closeness(cos: Column) -> Column:
    """1 / (1 + angle)."""
    return 1 / (1 + F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))
