"""Vectors as arrays of doubles, in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles; null where one is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def valid(v: Column, dim: int) -> Column:
    """Of so many dimensions, with finite components."""
    return F.coalesce((F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def padded(v: Column, dim: int) -> Column:
    """With zeros at the end up to dim components."""
    return F.concat(v, F.array_repeat(F.lit(0.0), F.greatest(F.lit(dim) - F.size(v), F.lit(0))))


def hashing_embedding(tokens: Column, dim: int = 64) -> Column:
    """A stand-in for a model: counts of token hashes by sign, of unit length where there are tokens."""
    counts = F.aggregate(tokens, F.array_repeat(F.lit(0.0), dim), lambda acc, t: F.zip_with(acc, F.sequence(F.lit(0), F.lit(dim - 1)), lambda x, i: x + F.when(F.pmod(F.xxhash64(t), F.lit(dim)) == i, F.when(F.xxhash64(t, F.lit(1)) > 0, 1.0).otherwise(-1.0)).otherwise(0.0)))
    return F.transform(counts, lambda x: F.when(dot(counts, counts) > 0, x / F.sqrt(dot(counts, counts))).otherwise(0.0))
