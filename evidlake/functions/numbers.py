"""Numeric expressions of the evaluation plane."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def settled(x: Column, places: int = 12) -> Column:
    """Without float residue, and without a negative zero."""
    return F.bround(x, places) + F.lit(0.0)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def citation_recall(expected: Column, cited: Column) -> Column:
    """The share of expected artefacts that are cited; 1 where nothing is expected."""
    found = F.size(F.filter(expected, lambda x: F.array_contains(cited, x)))
    return F.when(F.size(expected) == 0, 1.0).otherwise(found / F.size(expected))


def citation_precision(expected: Column, cited: Column) -> Column:
    """The share of citations that are expected. Nothing cited is 1 only where nothing is expected."""
    hits = F.size(F.filter(cited, lambda x: F.array_contains(expected, x)))
    return F.when(F.size(expected) == 0, 1.0).when(F.size(cited) == 0, 0.0).otherwise(hits / F.size(cited))


def verdict(mean: Column, low: Column, high: Column, threshold: float = 0.10) -> Column:
    """A difference is declared where the mean reaches the threshold and the interval leaves out zero."""
    return F.when(mean.isNull(), "no data").when((F.abs(mean) >= threshold) & ((low > 0) | (high < 0)), "difference").otherwise("inconclusive")


def backoff_minutes(attempts: Column) -> Column:
    """Minutes until the next attempt after so many failures: 0, 1, 2, 4, 8."""
    return F.when(attempts <= 1, F.lit(0)).otherwise(F.pow(F.lit(2), attempts - 2)).cast("int")
