"""Vector expressions in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0.0 for null, empty, zero or unequal vectors."""
    ok = (F.size(a) > 0) & (F.size(a) == F.size(b))
    d = norm(a) * norm(b)
    return F.when(ok & (d > 0), dot(a, b) / d).otherwise(F.lit(0.0))
