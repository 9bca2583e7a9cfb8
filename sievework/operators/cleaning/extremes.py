"""Outlier treatment: drop, clip or compress extreme values; missing cells stay missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sievework.errors import OperationError
from sievework.functions.columns import as_double, put
from sievework.operators.cleaning.base import Operation
from sievework.operators.outliers import bounds_from_quartiles, is_outlier


def _fences(facts) -> tuple[float, float]:
    bounds = bounds_from_quartiles(*facts["quantiles"])
    return bounds.lower, bounds.upper


def _outside(df: DataFrame, name: str, low: float | None, high: float | None) -> Column:
    if low is None or high is None:
        return F.lit(False)
    x = as_double(df, name)
    return F.coalesce((x < low) | (x > high), F.lit(False))


def _clip(df: DataFrame, name: str, low: float | None, high: float | None) -> DataFrame:
    if low is None or high is None:
        return df
    x = as_double(df, name)
    # greatest/least skip NULL, so a missing cell must be kept apart.
    return put(df, name, F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x))))


def _percentiles(params) -> list[float]:
    return [
        float(params.get("lower_percentile", 1)) / 100,
        float(params.get("upper_percentile", 99)) / 100,
    ]


def _far(df: DataFrame, name: str, params, facts) -> Column:
    if not facts["sd"]:
        return F.lit(False)
    score = F.abs(as_double(df, name) - facts["mean"]) / facts["sd"]
    return F.coalesce(score > float(params.get("threshold", 3.0)), F.lit(False))


def minimum(df: DataFrame, name: str, params) -> dict[str, Column]:
    return {"min": F.min(as_double(df, name))}


def above_minus_one(name: str, params, facts) -> None:
    if facts["min"] is not None and facts["min"] <= -1:
        raise OperationError(f"A log transform needs values above -1 in '{name}'.")


def log1p(df: DataFrame, name: str, params, facts) -> DataFrame:
    return put(df, name, F.log1p(as_double(df, name)))


def _iqr_outlier(df: DataFrame, name: str, params, facts) -> Column:
    return is_outlier(as_double(df, name), bounds_from_quartiles(*facts["quantiles"]))


OPERATIONS = [
    Operation(
        "outliers.keep",
        "Keep Outliers",
        lambda df, c, p, f: df,
        affected=lambda df, c, p, f: F.count_if(F.lit(False)),
        columns_changed=lambda df, c, f: 0,
        numbers_only=True,
    ),
    Operation(
        "outliers.remove",
        "Remove Outliers",
        lambda df, c, p, f: df.filter(~_iqr_outlier(df, c, p, f)),
        quantiles=lambda p: [0.25, 0.75],
        affected=lambda df, c, p, f: F.count_if(_iqr_outlier(df, c, p, f)),
        numbers_only=True,
        drops_rows=True,
    ),
    Operation(
        "outliers.iqr_capping",
        "IQR Capping",
        lambda df, c, p, f: _clip(df, c, *_fences(f)),
        quantiles=lambda p: [0.25, 0.75],
        affected=lambda df, c, p, f: F.count_if(_iqr_outlier(df, c, p, f)),
        numbers_only=True,
    ),
    Operation(
        "outliers.winsorization",
        "Winsorization",
        lambda df, c, p, f: _clip(df, c, *f["quantiles"]),
        quantiles=_percentiles,
        affected=lambda df, c, p, f: F.count_if(_outside(df, c, *f["quantiles"])),
        numbers_only=True,
    ),
    Operation(
        "outliers.zscore_filter",
        "Z-Score Filtering",
        lambda df, c, p, f: df.filter(~_far(df, c, p, f)),
        statistics=lambda df, c, p: {
            "mean": F.avg(as_double(df, c)),
            "sd": F.stddev_samp(as_double(df, c)),
        },
        affected=lambda df, c, p, f: F.count_if(_far(df, c, p, f)),
        numbers_only=True,
        drops_rows=True,
    ),
    Operation(
        "outliers.log_transform",
        "Log Transformation",
        log1p,
        statistics=minimum,
        verify=above_minus_one,
        numbers_only=True,
    ),
]
