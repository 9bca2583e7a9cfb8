"""Bias-adjusted moments from Spark's population ones."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def skewness(x: Column) -> Column:
    """Adjusted skewness G1; NULL below 3 values, 0 for a constant."""
    n = F.count(x).cast("double")
    adjusted = F.try_divide(F.skewness(x) * F.sqrt(n * (n - 1)), n - 2)
    return F.when(n >= 3, F.coalesce(adjusted, F.lit(0.0)))


def kurtosis(x: Column) -> Column:
    """Adjusted excess kurtosis G2; NULL below 4 values, 0 for a constant."""
    n = F.count(x).cast("double")
    adjusted = F.try_divide(((n + 1) * F.kurtosis(x) + 6) * (n - 1), (n - 2) * (n - 3))
    return F.when(n >= 4, F.coalesce(adjusted, F.lit(0.0)))
