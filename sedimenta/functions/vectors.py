"""Column functions over vectors, in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def to_unit(vector: Column) -> Column:
    """The vector over its length; null where it is empty, zero or not finite."""
    v = as_doubles(vector)
    n = norm(v)
    return F.when((n > 0) & (n < float("inf")), F.transform(v, lambda x: x / n))


def constant(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def cosine(a: Column, b: Column) -> Column:
    """Null where one of them is zero."""
    return F.try_divide(dot(as_doubles(a), as_doubles(b)), norm(as_doubles(a)) * norm(as_doubles(b)))
