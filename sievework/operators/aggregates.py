"""Aggregations over a table or its groups."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from sievework.errors import AggregationError
from sievework.functions.columns import (
    as_double,
    categorical_columns,
    is_numeric,
    is_integral,
    numeric_columns,
    quoted,
    require_columns,
    type_of,
)
from sievework.functions.frequencies import shown, top_values, value_frequencies
from sievework.functions.quantiles import exact_quantiles, grouped_quantiles, null_safe_join

OPERATIONS = ("sum", "avg", "min", "max", "count", "median")


@dataclass(frozen=True)
class Aggregation:
    operation: str
    column: str | None = None
    alias: str | None = None

    def name(self, index: int) -> str:
        return self.alias or f"{self.operation}_{self.column or index + 1}"


class Grouped(NamedTuple):
    """The first groups by the leading aggregate, all groups, and their number."""

    rows: DataFrame
    groups: DataFrame
    total: DataFrame


def _checked(df: DataFrame, spec: Aggregation, numbers_only: bool) -> None:
    if spec.operation not in OPERATIONS:
        raise AggregationError(f"Unsupported aggregation '{spec.operation}'.")
    if spec.column is None:
        if spec.operation != "count":
            raise AggregationError(f"'{spec.operation}' needs a column.")
        return
    require_columns(df, [spec.column])
    must_be_number = spec.operation in ("sum", "avg", "median") or (
        numbers_only and spec.operation != "count"
    )
    if must_be_number and not is_numeric(type_of(df, spec.column)):
        raise AggregationError(f"'{spec.operation}' needs a numeric column, not '{spec.column}'.")


def _expression(df: DataFrame, spec: Aggregation) -> Column:
    if spec.column is None:
        return F.count(F.lit(1))
    column = quoted(spec.column)
    if spec.operation == "sum":  # the sum of nothing is 0
        zero = F.lit(0) if is_integral(type_of(df, spec.column)) else F.lit(0.0)
        return F.coalesce(F.sum(column), zero)
    return {"avg": F.avg, "min": F.min, "max": F.max, "count": F.count}[spec.operation](column)


def aggregate(df: DataFrame, specs: Sequence[Aggregation]) -> DataFrame:
    """One row with one column per aggregation."""
    if not specs:
        raise AggregationError("At least one aggregation is required.")
    for spec in specs:
        _checked(df, spec, numbers_only=True)
    medians = exact_quantiles(
        df, {s.column: [0.5] for s in specs if s.operation == "median"}
    )
    plain = [
        _expression(df, s).alias(f"__{i}") for i, s in enumerate(specs) if s.operation != "median"
    ]
    one_row = df.agg(*plain) if plain else df.sparkSession.range(1)
    return one_row.select(
        [
            (
                F.lit(medians[s.column][0]).cast("double") if s.operation == "median" else F.col(f"__{i}")
            ).alias(s.name(i))
            for i, s in enumerate(specs)
        ]
    )


def group_by(
    df: DataFrame,
    keys: Sequence[str],
    specs: Sequence[Aggregation] = (),
    limit: int = 50,
    ascending: bool = False,
) -> Grouped:
    """Aggregate per group (missing keys form groups), ordered by the first aggregate.

    Ties are ordered by the group keys, missing aggregates come last.
    """
    require_columns(df, keys)
    specs = list(specs) or [Aggregation("count")]
    for spec in specs:
        _checked(df, spec, numbers_only=False)
    groups = [quoted(k) for k in keys]
    plain = [
        _expression(df, s).alias(s.name(i)) for i, s in enumerate(specs) if s.operation != "median"
    ]
    result = df.groupBy(*groups).agg(*plain) if plain else df.select(*groups).distinct()
    for i, s in enumerate(specs):
        if s.operation == "median":
            medians = grouped_quantiles(df, keys, s.column, {s.name(i): 0.5})
            result = null_safe_join(result, medians, keys)
    names = [s.name(i) for i, s in enumerate(specs)]
    result = result.select(*groups, *[quoted(n) for n in names])
    lead = quoted(names[0])
    order = [lead.asc_nulls_last() if ascending else lead.desc_nulls_last()]
    order += [g.asc_nulls_last() for g in groups]
    return Grouped(
        result.orderBy(*order).limit(limit),
        result,
        result.agg(F.count(F.lit(1)).alias("group_count")),
    )


def value_counts(
    df: DataFrame, column: str, limit: int = 10, include_missing: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The most frequent values, and a one-row distinct count."""
    require_columns(df, [column])
    return (
        top_values(df, column, limit, include_missing),
        count_distinct(df, column, include_missing),
    )


def count_distinct(
    df: DataFrame, column: str, include_missing: bool = False, approximate: bool = False
) -> DataFrame:
    """One row: how many different values; optionally counting 'missing' as one."""
    require_columns(df, [column])
    c = quoted(column)
    number = F.approx_count_distinct(c) if approximate else F.count_distinct(c)
    if include_missing:
        number = number + F.coalesce(F.max(c.isNull().cast("int")), F.lit(0))
    return df.agg(number.cast("long").alias("unique_value_count"))


def numeric_totals(df: DataFrame) -> DataFrame:
    """column, sum, mean, min, max, median for each numeric column with values."""
    names = numeric_columns(df)
    medians = exact_quantiles(df, {c: [0.5] for c in names})
    names = [c for c in names if medians[c][0] is not None]
    wide = df.agg(
        *[
            f(as_double(df, c)).alias(f"{label}{i}")
            for i, c in enumerate(names)
            for label, f in (("sum", F.sum), ("mean", F.avg), ("min", F.min), ("max", F.max))
        ]
        or [F.count(F.lit(1))]
    )
    lines = [
        F.struct(
            F.lit(c).alias("column_name"),
            *[F.col(f"{label}{i}").alias(label) for label in ("sum", "mean", "min", "max")],
            F.lit(medians[c][0]).cast("double").alias("median"),
        )
        for i, c in enumerate(names)
    ]
    if not lines:
        schema = "column_name string, sum double, mean double, min double, max double, median double"
        return df.sparkSession.createDataFrame([], schema)
    return wide.select(F.inline(F.array(*lines)))


def category_counts(
    df: DataFrame, columns: int = 5, max_distinct: int = 50, top: int = 15
) -> DataFrame:
    """column, value, count for the leading categorical columns of few values."""
    names = categorical_columns(df)[:columns]
    if not names:
        return df.sparkSession.createDataFrame([], "column_name string, value string, count long")
    counted = value_frequencies(df, names)
    few = (
        counted.groupBy("column_id")
        .agg(F.count(F.lit(1)).alias("d"))
        .filter(F.col("d") <= max_distinct)
        .select("column_id")
    )
    order = Window.partitionBy("column_id").orderBy(F.col("n").desc(), F.col("value"))
    labels = F.element_at(F.array(*[F.lit(n) for n in names]), F.substring("column_id", 2, 9).cast("int") + 1)
    return (
        counted.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= top)
        .join(F.broadcast(few), "column_id", "left_semi")  # at most one row per column
        .select(labels.alias("column_name"), shown(counted).alias("value"), F.col("n").alias("count"))
    )


def measure_by_category(df: DataFrame, category: str, measure: str, limit: int = 20) -> DataFrame:
    """Sum of a measure per category, largest first; missing categories kept."""
    return group_by(df, [category], [Aggregation("sum", measure, "total")], limit).rows


def duplicate_count(df: DataFrame) -> DataFrame:
    """One row: how many rows repeat another row in every column."""
    return (
        df.groupBy(*[quoted(c) for c in df.columns])
        .agg(F.count(F.lit(1)).alias("__n"))
        .agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_rows"))
    )

