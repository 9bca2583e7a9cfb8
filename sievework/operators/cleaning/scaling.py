"""Scaling: (x - centre) / spread, where a spread of zero counts as one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sievework.functions.columns import as_double, put
from sievework.operators.cleaning.base import Operation


def scaled(df: DataFrame, name: str, centre: float | None, spread: float | None) -> DataFrame:
    if centre is None:
        return put(df, name, as_double(df, name))
    return put(df, name, (as_double(df, name) - F.lit(float(centre))) / F.lit(float(spread or 1.0)))


def _stats(**build):
    return lambda df, c, p: {k: make(as_double(df, c)) for k, make in build.items()}


def _largest(x: Column) -> Column:
    return F.max(F.abs(x))


def _span(facts) -> float | None:
    return None if facts["min"] is None else facts["max"] - facts["min"]


def _quartile_span(facts) -> float | None:
    low, _, high = facts["quantiles"]
    return None if low is None else high - low


OPERATIONS = [
    Operation(
        "scaling.standard",
        "StandardScaler",
        lambda df, c, p, f: scaled(df, c, f["mean"], f["sd"]),
        statistics=_stats(mean=F.avg, sd=F.stddev_pop),
        numbers_only=True,
    ),
    Operation(
        "scaling.minmax",
        "MinMaxScaler",
        lambda df, c, p, f: scaled(df, c, f["min"], _span(f)),
        statistics=_stats(min=F.min, max=F.max),
        numbers_only=True,
    ),
    Operation(
        "scaling.robust",
        "RobustScaler",
        lambda df, c, p, f: scaled(df, c, f["quantiles"][1], _quartile_span(f)),
        quantiles=lambda p: [0.25, 0.5, 0.75],
        numbers_only=True,
    ),
    Operation(
        "scaling.maxabs",
        "MaxAbsScaler",
        lambda df, c, p, f: scaled(df, c, None if f["largest"] is None else 0.0, f["largest"]),
        statistics=_stats(largest=_largest),
        numbers_only=True,
    ),
]
