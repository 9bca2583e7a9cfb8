"""Duplicate rows: rows equal in every column, missing cells included."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sievework.functions.columns import quoted
from sievework.operators.cleaning.base import Operation


def _counted(df: DataFrame) -> DataFrame:
    return df.groupBy(*[quoted(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("__n"))


def _repeats(df, name, params, facts) -> DataFrame:
    return _counted(df).agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("affected_row_count"))


def _shared(df, name, params, facts) -> DataFrame:
    return _counted(df).agg(
        F.coalesce(F.sum(F.when(F.col("__n") > 1, F.col("__n"))), F.lit(0)).alias("affected_row_count")
    )


def _one_each(df, name, params, facts) -> DataFrame:
    return df.dropDuplicates()


def _only_unique(df, name, params, facts) -> DataFrame:
    return _counted(df).filter(F.col("__n") == 1).drop("__n")


def _all_columns(df, name, facts) -> int:
    return len(df.columns)


def _operation(key: str, label: str, rewrite, measure) -> Operation:
    return Operation(
        key, label, rewrite, measure=measure, columns_changed=_all_columns, whole_table=True, drops_rows=True
    )


# Copies are equal in every column, so keeping the first or the last gives the same table.
OPERATIONS = [
    _operation("duplicates.remove", "Remove Duplicate Rows", _one_each, _repeats),
    _operation("duplicates.keep_first", "Keep First", _one_each, _repeats),
    _operation("duplicates.keep_last", "Keep Last", _one_each, _repeats),
    _operation("duplicates.keep_unique", "Keep Unique", _only_unique, _shared),
]
