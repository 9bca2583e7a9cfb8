"""Type conversion: cells that do not parse become missing and are counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sievework.functions.columns import (
    as_double,
    is_boolean,
    is_integral,
    is_numeric,
    is_temporal,
    put,
    quoted,
    type_of,
)
from sievework.functions.parsing import (
    DATE_FORMATS,
    parse_boolean,
    parse_integer,
    parse_number,
    parse_timestamp,
)
from sievework.operators.cleaning.base import Operation


def _number(df: DataFrame, name: str) -> Column:
    data_type = type_of(df, name)
    if is_numeric(data_type) or is_boolean(data_type):
        return as_double(df, name)
    return parse_number(quoted(name).cast("string"))


def _integer(df: DataFrame, name: str) -> Column:
    data_type = type_of(df, name)
    if is_integral(data_type) or is_boolean(data_type):
        return quoted(name).cast("int").cast("long") if is_boolean(data_type) else quoted(name).cast("long")
    if is_numeric(data_type):
        return as_double(df, name).try_cast("long")
    return parse_integer(quoted(name).cast("string"))


def _timestamp(df: DataFrame, name: str, params) -> Column:
    data_type = type_of(df, name)
    if is_temporal(data_type):
        return quoted(name).cast("timestamp")
    if is_numeric(data_type):  # nanoseconds since 1970
        return F.timestamp_micros(F.floor(as_double(df, name) / 1000).cast("long"))
    return parse_timestamp(quoted(name).cast("string"), params.get("formats", DATE_FORMATS))


def _boolean(df: DataFrame, name: str) -> Column:
    if is_boolean(type_of(df, name)):
        return quoted(name)
    return parse_boolean(quoted(name).cast("string"))


def _checked_integer(df: DataFrame, name: str) -> Column:
    """Whole numbers only: a fraction fails the job rather than being cut off, without a scan of its own."""
    number, whole = _number(df, name), _integer(df, name)
    wrong = number.isNotNull() & (whole.isNull() | (number != F.floor(number)))
    message = F.concat(F.lit(f"'{name}' holds a value that is no whole number: "), quoted(name).cast("string"))
    return F.when(wrong, F.raise_error(message).cast("long")).otherwise(whole)


def _category(df: DataFrame, name: str, params, facts) -> DataFrame:
    marked = quoted(name).alias(name, metadata={"category": True})
    return df.select([marked if c == name else quoted(c) for c in df.columns])


def _rows(df, name, params, facts) -> Column:
    return F.count(F.lit(1))


def _failed(df: DataFrame, name: str, kind: str, params) -> dict[str, Column]:
    """How many filled cells a conversion cannot parse."""
    value = {
        "integer": lambda: _number(df, name),
        "float": lambda: _number(df, name),
        "datetime": lambda: _timestamp(df, name, params),
        "boolean": lambda: _boolean(df, name),
        "category": lambda: quoted(name),
    }[kind]()
    return {"failed_count": F.count_if(quoted(name).isNotNull() & value.isNull())}


def failures(df: DataFrame, spec) -> DataFrame:
    """One row: how many filled cells a conversion cannot parse."""
    found = _failed(df, spec.column_name, spec.operation_key.rsplit("_", 1)[1], spec.params)
    return df.agg(*[c.alias(k) for k, c in found.items()])


OPERATIONS = [
    Operation(
        "type_conversion.to_integer",
        "String → Integer",
        lambda df, c, p, f: put(df, c, _checked_integer(df, c)),
        affected=_rows,
        before=lambda df, c, p: _failed(df, c, "integer", p),
    ),
    Operation(
        "type_conversion.to_float",
        "String → Float",
        lambda df, c, p, f: put(df, c, _number(df, c)),
        affected=_rows,
        before=lambda df, c, p: _failed(df, c, "float", p),
    ),
    Operation(
        "type_conversion.to_datetime",
        "String → DateTime",
        lambda df, c, p, f: put(df, c, _timestamp(df, c, p)),
        affected=_rows,
        before=lambda df, c, p: _failed(df, c, "datetime", p),
    ),
    Operation(
        "type_conversion.to_boolean",
        "Boolean Conversion",
        lambda df, c, p, f: put(df, c, _boolean(df, c)),
        affected=_rows,
        before=lambda df, c, p: _failed(df, c, "boolean", p),
    ),
    Operation("type_conversion.to_category", "Category Conversion", _category, affected=_rows),
]
