"""Outlier bounds, reports and rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from sievework.errors import UnknownMethodError
from sievework.functions.columns import as_double, local_table, numeric_columns, quoted, require_numeric
from sievework.functions.ordering import Order, orders, sort_columns
from sievework.functions.quantiles import exact_quantiles

REPORT_SCHEMA = (
    "column_name string, detection_method string, q1 double, q3 double, iqr double, "
    "lower_bound double, upper_bound double, outlier_count long, outlier_percentage double"
)


class Bounds(NamedTuple):
    q1: float
    q3: float
    iqr: float
    lower: float
    upper: float


class OutlierRows(NamedTuple):
    rows: DataFrame
    total: DataFrame


def bounds_from_quartiles(q1: float | None, q3: float | None) -> Bounds:
    """Tukey fences; an empty column gives zeros."""
    if q1 is None or q3 is None:
        return Bounds(0.0, 0.0, 0.0, 0.0, 0.0)
    spread = q3 - q1
    return Bounds(q1, q3, spread, q1 - 1.5 * spread, q3 + 1.5 * spread)


def iqr_bounds(df: DataFrame, columns: Sequence[str], counts=None) -> dict[str, Bounds]:
    found = exact_quantiles(df, {c: [0.25, 0.75] for c in columns}, counts)
    return {c: bounds_from_quartiles(*found[c]) for c in columns}


# Methods by name; a new one is a function (df, columns, counts) -> bounds per column.
DETECTORS: dict[str, Callable[..., dict[str, Bounds]]] = {"iqr": iqr_bounds}


def detect(df: DataFrame, columns: Sequence[str], method: str = "iqr", counts=None) -> dict[str, Bounds]:
    if method not in DETECTORS:
        raise UnknownMethodError(f"No outlier method '{method}'.")
    return DETECTORS[method](df, columns, counts)


def is_outlier(x: Column, bounds: Bounds) -> Column:
    """False for missing cells."""
    return F.coalesce((x < bounds.lower) | (x > bounds.upper), F.lit(False))


def bounds_table(df: DataFrame, columns: Sequence[str] | None = None, method: str = "iqr") -> DataFrame:
    """One row per numeric column: quartiles, their spread and the fences."""
    names = list(columns or numeric_columns(df))
    found = detect(df, names, method)
    return local_table(
        df.sparkSession,
        [(c, *found[c]) for c in names],
        "column_name string, q1 double, q3 double, iqr double, lower_bound double, upper_bound double",
    )


def report(
    df: DataFrame, columns: Sequence[str] | None = None, method: str = "iqr", bounds=None
) -> DataFrame:
    """One row per numeric column: fences and how many of all rows lie outside."""
    names = list(columns or numeric_columns(df))
    if not names:
        return df.sparkSession.createDataFrame([], REPORT_SCHEMA)
    found = bounds or detect(df, names, method)
    wide = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(is_outlier(as_double(df, c), found[c])).alias(f"o{i}") for i, c in enumerate(names)],
    )
    lines = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit(method).alias("detection_method"),
            *[
                F.lit(float(v)).alias(n)
                for n, v in zip(("q1", "q3", "iqr", "lower_bound", "upper_bound"), found[c])
            ],
            F.col(f"o{i}").alias("outlier_count"),
            F.coalesce(F.try_divide(F.col(f"o{i}") * 100.0, F.col("rows")), F.lit(0.0)).alias(
                "outlier_percentage"
            ),
        )
        for i, c in enumerate(names)
    ]
    return wide.select(F.inline(F.array(*lines)))


def sample_positions(
    df: DataFrame, order_by: Sequence[str | Order] | str, bounds: dict[str, Bounds], limit: int = 50
) -> DataFrame:
    """(column_name, keys): the first ``limit`` outlier rows of each column, by sort key."""
    keys = orders(order_by)
    names = list(bounds)
    flags = F.filter(
        F.array(*[F.when(is_outlier(as_double(df, c), bounds[c]), F.lit(i)) for i, c in enumerate(names)]),
        lambda i: i.isNotNull(),
    )
    hits = df.select(*[quoted(k.column) for k in keys], F.explode(flags).alias("__c"))
    first = Window.partitionBy("__c").orderBy(*sort_columns(keys))
    ranked = hits.withColumn("__r", F.row_number().over(first)).filter(F.col("__r") <= limit)
    key = F.struct(*[quoted(k.column) for k in keys])
    # At most ``limit`` keys per column are collected into the list.
    return ranked.groupBy("__c").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("__r", key.alias("k")))), lambda s: s["k"]).alias("keys")
    ).select(F.element_at(F.array(*[F.lit(c) for c in names]), F.col("__c") + 1).alias("column_name"), "keys")


def outlier_rows(
    df: DataFrame,
    column: str,
    order_by: Sequence[str | Order] | str,
    limit: int = 500,
    method: str = "iqr",
) -> OutlierRows:
    """Rows whose value lies outside the fences: the first ``limit`` and their number."""
    require_numeric(df, column)
    outside = df.filter(is_outlier(as_double(df, column), detect(df, [column], method)[column]))
    return OutlierRows(
        outside.orderBy(*sort_columns(order_by)).limit(limit),
        outside.agg(F.count(F.lit(1)).alias("row_count")),
    )
