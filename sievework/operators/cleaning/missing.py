"""Missing values: drop, fill with a statistic, fill along an order, fill from a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sievework.errors import OperationError
from sievework.functions.columns import (
    as_double,
    is_integral,
    is_numeric,
    is_text,
    numeric_columns,
    put,
    quoted,
    type_of,
)
from sievework.functions.frequencies import most_frequent
from sievework.functions.ordering import with_neighbours
from sievework.operators.cleaning.base import Operation, count_missing
from sievework.operators.cleaning.forest import forest_impute
from sievework.operators.cleaning.neighbours import neighbour_impute


def _fill_number(df: DataFrame, name: str, value: float | None) -> DataFrame:
    if value is None:
        return df
    return put(df, name, F.coalesce(as_double(df, name), F.lit(float(value))))


def _fill_mode(df: DataFrame, name: str, params, facts) -> DataFrame:
    if facts["mode"] is None:
        return df
    return put(df, name, F.coalesce(quoted(name), F.lit(facts["mode"]).cast(type_of(df, name))))


def _fill_constant(df: DataFrame, name: str, params, facts) -> DataFrame:
    value = params.get("value", "Unknown")
    data_type, column = type_of(df, name), quoted(name)
    if is_text(data_type):
        return put(df, name, F.coalesce(column, F.lit(str(value))))
    if is_integral(data_type) and isinstance(value, float) and not value.is_integer():
        return put(df, name, F.coalesce(column.cast("double"), F.lit(value)))
    fits = F.lit(str(value)).try_cast(data_type)
    if is_numeric(data_type) and _reads_as_number(value) or not isinstance(value, str):
        return put(df, name, F.coalesce(column, fits))
    # A word among numbers: the column becomes text.
    return put(df, name, F.coalesce(column.cast("string"), F.lit(value)))


def _reads_as_number(value) -> bool:
    try:
        float(str(value))
        return True
    except ValueError:
        return False


def order_of(name: str, params) -> list:
    keys = params.get("order_by")
    if not keys:
        raise OperationError(f"'{name}' can only be filled along a row order: give params.order_by.")
    return [keys] if isinstance(keys, str) else list(keys)


def _options(params) -> dict:
    return {"rows_per_range": params["rows_per_range"]} if "rows_per_range" in params else {}


def _fill_along(side: str):
    def rewrite(df: DataFrame, name: str, params, facts) -> DataFrame:
        near = with_neighbours(df, name, order_of(name, params), [side], **_options(params))
        filled = F.coalesce(quoted(name), F.col(f"__{side}.v"))
        return near.select([filled.alias(c) if c == name else quoted(c) for c in df.columns])

    return rewrite


def _interpolate(df: DataFrame, name: str, params, facts) -> DataFrame:
    """Linear in row position; before the first and after the last value, the nearest one."""
    numeric = put(df, name, as_double(df, name))
    near = with_neighbours(numeric, name, order_of(name, params), ["before", "after"], True, **_options(params))
    a, b = F.col("__before"), F.col("__after")
    step = (F.col("__position") - a["p"]) / (b["p"] - a["p"])
    between: Column = a["v"] + (b["v"] - a["v"]) * step
    filled = F.coalesce(
        quoted(name), F.when(a.isNull(), b["v"]).when(b.isNull(), a["v"]).otherwise(between)
    )
    return near.select([filled.alias(c) if c == name else quoted(c) for c in df.columns])


def _all_numeric(df: DataFrame, name: str, params) -> list[str]:
    return [*numeric_columns(df), *([] if name in numeric_columns(df) else [name])]


def _needs_numeric(df: DataFrame, name: str) -> None:
    if not is_numeric(type_of(df, name)):
        raise OperationError(f"'{name}' is not numeric.")


def _knn(df: DataFrame, name: str, params, facts) -> DataFrame:
    _needs_numeric(df, name)
    return neighbour_impute(df, int(params.get("n_neighbors", 5)), int(params.get("leaf_rows", 20_000)))


def _forest(df: DataFrame, name: str, params, facts) -> DataFrame:
    _needs_numeric(df, name)
    known = {k: params[k] for k in ("trees", "rounds", "depth") if k in params}
    return forest_impute(df, **known)


OPERATIONS = [
    Operation(
        "missing_values.drop_rows",
        "Drop Rows",
        lambda df, c, p, f: df.filter(quoted(c).isNotNull()),
        affected=count_missing,
        drops_rows=True,
    ),
    Operation("missing_values.drop_columns", "Drop Columns", lambda df, c, p, f: df.drop(quoted(c))),
    Operation(
        "missing_values.mean",
        "Mean",
        lambda df, c, p, f: _fill_number(df, c, f["mean"]),
        statistics=lambda df, c, p: {"mean": F.avg(as_double(df, c))},
        affected=count_missing,
        numbers_only=True,
    ),
    Operation(
        "missing_values.median",
        "Median",
        lambda df, c, p, f: _fill_number(df, c, f["quantiles"][0]),
        quantiles=lambda p: [0.5],
        affected=count_missing,
        numbers_only=True,
    ),
    Operation(
        "missing_values.mode",
        "Mode",
        _fill_mode,
        learn=lambda df, c, p: {"mode": most_frequent(df, c)},
        affected=count_missing,
    ),
    Operation(
        "missing_values.forward_fill", "Forward Fill", _fill_along("before"), affected=count_missing,
        learn=lambda df, c, p: {"order": order_of(c, p)},
    ),
    Operation(
        "missing_values.backward_fill", "Backward Fill", _fill_along("after"), affected=count_missing,
        learn=lambda df, c, p: {"order": order_of(c, p)},
    ),
    Operation("missing_values.constant", "Constant Value", _fill_constant, affected=count_missing),
    Operation(
        "missing_values.knn", "KNN Imputer", _knn, affected=count_missing, reads=_all_numeric,
        learn=lambda df, c, p: {},
    ),
    Operation(
        "missing_values.missforest", "MissForest", _forest, affected=count_missing, reads=_all_numeric,
        learn=lambda df, c, p: {},
    ),
    Operation(
        "missing_values.interpolate", "Interpolation", _interpolate, affected=count_missing,
        numbers_only=True, learn=lambda df, c, p: {"order": order_of(c, p)},
    ),
]
