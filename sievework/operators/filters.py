"""Typed row filters: every condition is one Catalyst predicate, so it reaches the scan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, datetime
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, functions as F, types as T

from sievework.errors import FilterError
from sievework.functions.columns import is_boolean, is_numeric, is_temporal, quoted, require_columns, type_of
from sievework.functions.ordering import Order, sort_columns

# Spellings a boolean column is compared with.
_TRUE = ("true", "1", "yes")
_FALSE = ("false", "0", "no")


@dataclass(frozen=True)
class Condition:
    column: str
    operator: str
    value: Any = None


class Filtered(NamedTuple):
    """All matching rows, the first ``limit`` of them, and a one-row match count."""

    matches: DataFrame
    rows: DataFrame
    total: DataFrame


#: Date layouts tried after ISO; a month comes before a day where both are numbers.
_LAYOUTS = (
    "%Y-%m-%d %H:%M:%S", "%Y/%m/%d", "%m/%d/%Y", "%m/%d/%Y %H:%M:%S", "%m/%d/%Y %H:%M", "%d-%b-%Y", "%d %b %Y", "%d %B %Y", "%b %d, %Y",
    "%B %d, %Y", "%Y%m%d",
)


def coerce_literal(df: DataFrame, column: str, value: Any) -> Any:
    """The Python value to compare ``column`` with; unusable numbers and dates are errors."""
    data_type = type_of(df, column)
    if value is None:
        return None
    if is_boolean(data_type):
        word = str(value).strip().lower()
        if word in _TRUE:
            return True
        if word in _FALSE:
            return False
        return str(value)
    if is_numeric(data_type):
        if isinstance(value, (bool, int, float)):
            return value
        try:
            text = str(value).strip()
            return int(text) if text.lstrip("+-").isdigit() else float(text)
        except ValueError as error:
            raise FilterError(f"'{value}' is not a number ('{column}').") from error
    if is_temporal(data_type):
        if isinstance(value, (datetime, date)):
            return value
        for layout in (None, *_LAYOUTS):
            try:
                text = str(value).strip()
                return datetime.fromisoformat(text) if layout is None else datetime.strptime(text, layout)
            except ValueError:
                continue
        raise FilterError(f"'{value}' is not a date or time ('{column}').")
    return str(value)


def predicate(df: DataFrame, condition: Condition) -> Column:
    """One condition; a missing cell only ever passes ``!=``.

    NaN is treated as missing here, so a raw scan can be filtered directly and
    the comparison itself is pushed into it.
    """
    require_columns(df, [condition.column])
    column = quoted(condition.column)
    operator = condition.operator
    text = column.cast("string")
    if operator == "contains":  # a case-insensitive pattern
        return F.coalesce(text.rlike(f"(?iu){condition.value}"), F.lit(False))
    if operator == "starts_with":
        return F.coalesce(text.startswith(str(condition.value)), F.lit(False))
    if operator == "ends_with":
        return F.coalesce(text.endswith(str(condition.value)), F.lit(False))

    value = coerce_literal(df, condition.column, condition.value)
    comparable = not (is_boolean(type_of(df, condition.column)) and isinstance(value, str))
    if operator in ("=", "==", "is"):
        return column == F.lit(value) if value is not None and comparable else F.lit(False)
    if operator == "!=":
        if value is None or not comparable:
            return F.lit(True)
        return ~column.eqNullSafe(F.lit(value))
    if value is None or not comparable:
        raise FilterError(f"'{operator}' needs a value comparable with '{condition.column}'.")
    # Spark orders NaN above every number.
    fraction = isinstance(type_of(df, condition.column), (T.FloatType, T.DoubleType))
    known = ~F.isnan(column) if fraction else F.lit(True)
    compare = {
        ">": (column > F.lit(value)) & known,
        ">=": (column >= F.lit(value)) & known,
        "<": column < F.lit(value),
        "<=": column <= F.lit(value),
    }.get(operator)
    if compare is None:
        raise FilterError(f"Unsupported filter operator '{operator}'.")
    return compare


def keep_rows(df: DataFrame, conditions: Sequence[Condition]) -> DataFrame:
    """Rows meeting all conditions."""
    for condition in conditions:
        df = df.filter(predicate(df, condition))
    return df


def filter_rows(
    df: DataFrame,
    conditions: Sequence[Condition],
    limit: int = 50,
    order_by: Sequence[str | Order] | str | None = None,
) -> Filtered:
    """All conditions, then the first ``limit`` rows (along ``order_by`` if given)."""
    matches = keep_rows(df, conditions)
    front = matches.orderBy(*sort_columns(order_by)) if order_by else matches
    return Filtered(matches, front.limit(limit), matches.agg(F.count(F.lit(1)).alias("row_count")))
