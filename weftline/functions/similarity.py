"""Similarity of two value arrays as column expressions; all arithmetic in double, no Python in the plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def doubles(values: Column) -> Column:
    return values.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def _ratio(na: Column, nb: Column, value: Column) -> Column:
    """1 if both norms are zero, 0 if one is, else `value`."""
    return F.when((na == 0) & (nb == 0), 1.0).when((na == 0) | (nb == 0), 0.0).otherwise(value)


def cosine(a: Column, b: Column) -> Column:
    na, nb = norm(a), norm(b)
    return _ratio(na, nb, dot(a, b) / (na * nb))


def cosine_of_elements(x: Column, y: Column) -> Column:
    """Aggregate: cosine of two tensors given as rows of elements; one pass, partial sums per task."""
    nx, ny = F.sqrt(F.sum(x * x)), F.sqrt(F.sum(y * y))
    return _ratio(nx, ny, F.sum(x * y) / (nx * ny))


def magnitude(a: Column, b: Column) -> Column:
    na, nb = norm(a), norm(b)
    return _ratio(na, nb, F.least(na, nb) / F.greatest(na, nb))


def hybrid(cos: Column, mag: Column, direction_weight: float = 0.7, magnitude_weight: float = 0.3) -> Column:
    """Weighted mean of direction (cosine moved to 0..1) and magnitude similarity."""
    both = direction_weight + magnitude_weight
    if both <= 0:
        raise ValueError("at least one weight must be positive")
    return (F.lit(direction_weight / both) * (cos + 1.0) / 2.0) + F.lit(magnitude_weight / both) * mag


def matches(cos: Column, mag: Column, threshold: float, tolerance: float = 0.1) -> Column:
    """The three tests a near copy must pass: direction, magnitude, and a hybrid score above the threshold."""
    return (cos >= threshold) & (mag >= 1.0 - tolerance) & (hybrid(cos, mag) > threshold)


def allclose(a: Column, b: Column, absolute: float, relative: float = 1e-5) -> Column:
    return F.forall(F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y) <= absolute + relative * F.abs(y)), lambda ok: ok)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def estimated_cosine(distance: Column, bits: int = 64) -> Column:
    return F.cos(F.lit(3.141592653589793) * distance / bits)


def element_count(shape: Column) -> Column:
    return F.aggregate(shape, F.lit(1).cast("long"), lambda a, x: a * x)
