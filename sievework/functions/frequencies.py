"""Value frequencies of many columns in one shuffle, and key lookups that survive hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from sievework.functions.columns import is_integral, is_numeric, quoted, type_of
from sievework.session import materialize

LOOKUP_ROWS = 100_000
LOOKUP_BYTES = 16 << 20
_HOT_KEYS = 10_000
_NULL_SALTS = 256


def value_frequencies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_id, value, n): how often each non-missing value occurs in each column.

    ``value`` is a struct of one typed slot per kind (whole number, fraction, each
    decimal type, text), so numbers keep their own order and all their digits.  The
    rows are combined before the shuffle: a value that fills a third of the
    table leaves each task as one row.
    """
    slots = []
    exact = sorted({type_of(df, c).simpleString() for c in columns if isinstance(type_of(df, c), T.DecimalType)})
    for name in columns:
        data_type, column = type_of(df, name), quoted(name)
        whole, fraction, text = F.lit(None), F.lit(None), F.lit(None)
        if isinstance(data_type, T.DecimalType):
            pass
        elif is_integral(data_type):
            whole = column
        elif is_numeric(data_type):
            fraction = column.cast("double") + F.lit(0.0)  # -0.0 and 0.0 are one value
        elif data_type.typeName() in ("array", "map", "struct", "variant"):
            text = F.to_json(column)
        else:
            text = column.cast("string")
        slot = F.struct(
            whole.cast("bigint").alias("whole"),
            fraction.cast("double").alias("fraction"),
            *[F.when(F.lit(data_type.simpleString() == e), column).cast(e).alias(e) for e in exact],
            text.cast("string").alias("text"),
        )
        slots.append(F.when(column.isNotNull(), slot))
    wide = df.select([s.alias(f"c{i}") for i, s in enumerate(slots)])
    ids = [f"c{i}" for i in range(len(slots))]
    return (
        wide.unpivot([], ids, "column_id", "value")
        .filter(F.col("value").isNotNull())
        .groupBy("column_id", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def shown(counted: DataFrame) -> Column:
    """The ``value`` of counted frequencies as text."""
    slots = counted.schema["value"].dataType.names
    return F.coalesce(*[F.col("value").getField(s).cast("string") for s in reversed(slots)])


def column_summaries(df: DataFrame, columns: Sequence[str], samples: int = 5) -> dict[str, dict]:
    """Per column: distinct count, most frequent value (smallest on ties), smallest values.

    The result has one row per column, so it is returned to the driver.
    """
    if not columns:
        return {}
    counted = value_frequencies(df, columns)
    # Smallest values first, ties in count resolved by the smallest value.
    best = F.min_by(F.col("value"), F.struct((-F.col("n")).alias("n"), F.col("value").alias("v")))
    ranked = counted.withColumn(
        "rank", F.row_number().over(Window.partitionBy("column_id").orderBy("value"))
    ).filter((F.col("rank") <= samples) & (F.col("n") > 0))  # reads n, so both branches share one exchange
    totals = counted.groupBy("column_id").agg(
        F.count(F.lit(1)).alias("distinct"), best.alias("top"), F.max("n").alias("top_count")
    )
    smallest = ranked.groupBy("column_id").agg(F.sort_array(F.collect_list("value")).alias("smallest"))
    rows = totals.join(smallest, "column_id").collect()
    found = {c: {"distinct": 0, "top": None, "top_count": 0, "smallest": []} for c in columns}
    for row in rows:
        found[columns[int(row["column_id"][1:])]] = {
            "distinct": row["distinct"],
            "top": _plain(row["top"]),
            "top_count": row["top_count"],
            "smallest": [_plain(v) for v in row["smallest"]],
        }
    return found


def _plain(slot):
    for part in slot:
        if part is not None:
            return part
    return None


def top_values(df: DataFrame, column: str, limit: int, include_missing: bool = False) -> DataFrame:
    """(value, count) by falling count, ties by value; the missing bucket is optional."""
    rows = df if include_missing else df.filter(quoted(column).isNotNull())
    return (
        rows.groupBy(quoted(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.col("count").desc(), F.col("value").asc_nulls_last())
        .limit(limit)
    )


def most_frequent(df: DataFrame, column: str):
    """The smallest of the most frequent values, or None."""
    row = top_values(df, column, 1).first()
    return None if row is None else row["value"]


def attach(
    df: DataFrame, column: str, lookup: DataFrame, output: str, bound: int = LOOKUP_ROWS, most_bytes: int = LOOKUP_BYTES
) -> DataFrame:
    """Replace ``column`` by the value ``lookup`` holds for it; unknown and missing become NULL.

    ``lookup`` has columns (key, value, n) with one row per key and the number
    ``n`` of table rows having it.  Up to ``bound`` keys of ``most_bytes`` in all it
    is broadcast.  A larger one is joined by shuffle, except for its most frequent
    keys: those are few, so they are broadcast, and rows they settle carry a missing
    key with a salt into the join.  Either way the table is read once.
    """
    key = quoted(column)
    lookup = materialize(lookup, "lookup")
    width = F.length(F.to_json(F.struct("key", "value")))
    size = lookup.agg(F.count(F.lit(1)).alias("rows"), F.sum(width).alias("bytes"), F.max(width).alias("widest")).first()
    table = lookup.select(F.col("key").alias("__key"), F.col("value").alias("__value"))
    if size["rows"] <= bound and (size["bytes"] or 0) <= most_bytes:
        return df.join(F.broadcast(table), key == F.col("__key"), "left").select(
            [F.col("__value").alias(output) if c == column else quoted(c) for c in df.columns]
        )
    few = max(1, min(_HOT_KEYS, bound, most_bytes // size["widest"]))
    frequent = lookup.orderBy(F.col("n").desc(), F.col("key")).limit(few)
    hot = frequent.select(F.col("key").alias("__hot"), F.col("value").alias("__hot_value"))
    marked = df.join(F.broadcast(hot), key == F.col("__hot"), "left")
    settled = F.col("__hot").isNotNull() | key.isNull()
    spread = F.when(settled, (F.rand(7) * _NULL_SALTS).cast("int") + 1).otherwise(F.lit(0))
    marked = marked.withColumn("__open", F.when(~settled, key)).withColumn("__salt", spread)
    rest = table.withColumn("__zero", F.lit(0))
    joined = marked.join(rest, (F.col("__open") == F.col("__key")) & (F.col("__salt") == F.col("__zero")), "left")
    value = F.when(F.col("__hot").isNotNull(), F.col("__hot_value")).otherwise(F.col("__value"))
    return joined.select([value.alias(output) if c == column else quoted(c) for c in df.columns])
