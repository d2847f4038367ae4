"""Vector expressions in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where either is null or zero, or their lengths differ."""
    a, b = doubles(a), doubles(b)
    norms = F.sqrt(dot(a, a) * dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms)


def unit(v: Column, least: float = 1e-9) -> Column:
    """Length 1; a vector shorter than `least` stays."""
    norm = lambda x: F.sqrt(dot(x, x))
    return let(doubles(v), lambda x: let(norm(x), lambda n: F.when(n < least, x).otherwise(F.transform(x, lambda y: y / n))))


def strict_unit(v: Column) -> Column:
    """Length 1; a zero vector is an error."""
    return F.when(dot(doubles(v), doubles(v)) > 0, unit(v, 0.0)).otherwise(F.raise_error(F.lit("a zero vector has no direction")))
