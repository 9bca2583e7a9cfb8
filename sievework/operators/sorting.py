"""Sorting, first rows and pages."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from sievework.functions.columns import quoted, require_columns
from sievework.functions.ordering import Order, orders, page_of, sort_columns


class Page(NamedTuple):
    """The rows of one page and a one-row description of the paging."""

    rows: DataFrame
    info: DataFrame


def sort_rows(
    df: DataFrame,
    column: str,
    ascending: bool = True,
    limit: int = 50,
    tie_break: Sequence[str | Order] | str = (),
) -> DataFrame:
    """The first ``limit`` rows by one column; missing values last both ways."""
    ties = orders(tie_break) if tie_break else []
    require_columns(df, [column, *[t.column for t in ties]])
    return df.orderBy(*sort_columns([Order(column, ascending), *ties])).limit(limit)


def head(df: DataFrame, order_by: Sequence[str | Order] | str, rows: int = 5, most: int | None = None) -> DataFrame:
    """The first rows along a key, one at least; ``most`` holds a caller to a number (50 in a chat)."""
    return df.orderBy(*sort_columns(order_by)).limit(max(1, rows if most is None else min(rows, most)))


def paginate(
    df: DataFrame,
    order_by: Sequence[str | Order] | str,
    page: int = 1,
    page_size: int = 1000,
    row_limit: int = 1000,
    **options,
) -> Page:
    """One page along a unique key.  Size is held to 1..row_limit and page to 1 or more."""
    size = max(1, min(page_size, row_limit))
    number = max(1, page)
    rows = page_of(df, order_by, (number - 1) * size, size, **options)
    total = F.count(F.lit(1))
    shown = F.greatest(F.lit(0), F.least(F.lit(size), F.col("total_rows") - F.lit((number - 1) * size)))
    info = (
        df.agg(total.alias("total_rows"))
        .withColumn("page", F.lit(number))
        .withColumn("page_size", F.lit(size))
        .withColumn("total_pages", F.greatest(F.lit(1), F.ceil(F.col("total_rows") / size)).cast("long"))
        .withColumn("truncated", F.col("total_rows") > shown)
    )
    return Page(rows, info)


def preview_table(
    df: DataFrame, order_by: Sequence[str | Order] | str, page: int = 1, page_size: int = 25
) -> Page:
    """A page of at most 100 rows of a table."""
    return paginate(df, order_by, page, page_size, row_limit=100)


def preview(
    df: DataFrame, rows: int = 10, order_by: Sequence[str | Order] | str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(one row per column: type, rows, columns, missing cells; the first rows)."""
    front = df.orderBy(*sort_columns(order_by)) if order_by else df
    fields = df.schema.fields
    wide = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(quoted(f.name).isNull()).alias(f"m{i}") for i, f in enumerate(fields)],
    )
    lines = [
        F.struct(
            F.lit(i + 1).alias("ordinal"),
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("dtype"),
            F.col("rows").alias("row_count"),
            F.lit(len(fields)).alias("column_count"),
            F.col(f"m{i}").alias("missing_count"),
        )
        for i, f in enumerate(fields)
    ]
    return wide.select(F.inline(F.array(*lines))), front.limit(rows)
