"""Column kinds and small expression helpers shared by every operator."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from sievework.errors import NotNumericError, UnknownColumnError

_FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)

# White space as Python's str.split and \s see it (fixed value).
WHITESPACE = "(?U)[\\s\\x1c-\\x1f]+"


def quoted(name: str) -> Column:
    """A column by its literal name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def type_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric(data_type: T.DataType) -> bool:
    """Numbers only: booleans count as categories."""
    return isinstance(data_type, _INTEGRAL + _FRACTIONAL)


def is_integral(data_type: T.DataType) -> bool:
    return isinstance(data_type, _INTEGRAL)


def is_boolean(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.BooleanType)


def is_temporal(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_text(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.StringType, T.CharType, T.VarcharType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def categorical_columns(df: DataFrame) -> list[str]:
    """Everything that is neither numeric nor typeless (all missing)."""
    return [
        f.name
        for f in df.schema.fields
        if not is_numeric(f.dataType) and not isinstance(f.dataType, T.NullType)
    ]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_text(f.dataType)]


def require_columns(df: DataFrame, names: Iterable[str | None]) -> None:
    known = set(df.columns)
    missing = sorted({str(n) for n in names if n not in known})
    if missing:
        raise UnknownColumnError("Not in this table: " + ", ".join(missing))


def require_numeric(df: DataFrame, name: str) -> None:
    require_columns(df, [name])
    if not is_numeric(type_of(df, name)):
        raise NotNumericError(f"'{name}' is not numeric.")


def as_double(df: DataFrame, name: str) -> Column:
    """The column as a double; booleans become 0/1."""
    column = quoted(name)
    if is_boolean(type_of(df, name)):
        return column.cast("int").cast("double")
    return column.cast("double")


def put(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Replace one column, keeping its place in the schema."""
    return df.select([value.alias(c) if c == name else quoted(c) for c in df.columns])


def words(text: Column) -> Column:
    """White-space separated words, as an array without empty entries."""
    return F.filter(F.split(text, WHITESPACE), lambda w: w != "")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn floating NaN into NULL so that both mean 'missing' from the scan on."""
    floats = {
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))
    }
    if not floats:
        return df
    return df.select(
        [
            F.when(~F.isnan(quoted(c)), quoted(c)).alias(c) if c in floats else quoted(c)
            for c in df.columns
        ]
    )


def json_safe(df: DataFrame) -> DataFrame:
    """NaN to NULL and temporal columns to ISO-8601 text."""
    out = nan_to_null(df)
    columns = []
    for field in out.schema.fields:
        column = quoted(field.name)
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            seconds = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")
            micros = F.date_format(column, "SSSSSS")
            column = F.when(micros == "000000", seconds).otherwise(F.concat_ws(".", seconds, micros))
            column = F.when(quoted(field.name).isNotNull(), column)
        elif isinstance(field.dataType, T.DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        columns.append(column.alias(field.name))
    return out.select(columns)


def local_table(spark, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small driver-made table (one row per column, statistic or category)."""
    return spark.createDataFrame([tuple(r) for r in rows], schema)
