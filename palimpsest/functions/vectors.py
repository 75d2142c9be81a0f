"""Vector expressions over array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a.cast("array<double>"), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; null for a missing or zero vector or for unequal dimensions."""
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), norm(a) * norm(b)))


def sign_bits(a: Column) -> Column:
    return F.transform(a, lambda x: x > 0)


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(sign_bits(a), sign_bits(b), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)


def packed_signs(a: Column) -> Column:
    """Sign bits as 64-bit words, first component in the lowest bit."""
    words = F.sequence(F.lit(0), F.expr("0") + F.floor((F.size(a) - 1) / 64).cast("int"))
    bit = lambda w: F.transform(F.slice(a, w * 64 + 1, F.lit(64)), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.transform(words, lambda w: F.aggregate(bit(w), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x)))


def information_score(distance: Column, dim: int) -> Column:
    return 1 - distance / F.lit(float(dim))


def int8(a: Column) -> Column:
    return F.transform(a, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x * 127).cast("int"))))
