"""Dense vectors as array<double>: products, norms and ranking scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-12


def as_vector(values: list[float] | Column) -> Column:
    if isinstance(values, Column):
        return values.cast("array<double>")
    if isinstance(values, (str, bytes)) or not all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in values):
        raise ValueError("embedding must be a numeric sequence")
    return F.array(*[F.lit(float(x)) for x in values])


def inner(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    return inner(a, b) / F.greatest(norm(a) * norm(b), F.lit(EPSILON))


def unit(a: Column) -> Column:
    size = F.greatest(norm(a), F.lit(EPSILON))
    return F.transform(a, lambda x: x / size)
