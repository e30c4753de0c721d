"""Vectors are array<double>; dot products stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, na: Column | None = None, nb: Column | None = None) -> Column:
    """Null for a zero vector, a null vector, or unlike lengths, so thresholds drop the row."""
    return F.when(F.size(a) == F.size(b), dot(a, b) / F.nullif((norm(a) if na is None else na) * (norm(b) if nb is None else nb), F.lit(0.0)))


def guarded_cosine(a: Column, b: Column) -> Column:
    """Zero for a zero vector."""
    return F.coalesce(cosine(a, b), F.lit(0.0))


def mean_vector(v: Column, dim: int) -> Column:
    """Aggregate: element-wise mean of arrays of `dim` numbers, one hash aggregate with map-side sums."""
    return F.array(*[F.avg(F.get(v, F.lit(i)).cast("double")) for i in range(dim)])


def parse_vector(text: Column) -> Column:
    return F.from_json(text, "array<double>")
