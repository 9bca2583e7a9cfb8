"""Ordered work without a single-partition window.

A table has no row order in Spark, so operators that need one take a unique
sort key.  A window over the whole table would put every row in one task.
Here rows are cut into key ranges instead, each range is windowed on its own,
and what crosses a range border (a carried value, a row offset) is a summary of
one row per range.  Range borders come from a sample of the keys; they only
decide how even the ranges are, never the result.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from sievework.functions.columns import is_boolean, is_numeric, is_temporal, is_text, is_integral, quoted, type_of

RANGE = "__range"
ROWS_PER_RANGE = 1_000_000
_SAMPLE_PER_RANGE = 32
#: Ranges up to which so many keys are sampled for each; beyond, fewer are, since many ranges even out.
_WELL_SAMPLED = 16_384
#: Up to so many borders are compared one by one.
_FEW_BORDERS = 16
#: Keys that a look for a page takes to the driver.
_KEYS_PER_LOOK = 10_000
_JSON = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "ignoreNullFields": "false",
}


@dataclass(frozen=True)
class Order:
    """One sort key; missing values come last in both directions."""

    column: str
    ascending: bool = True

    def sort_column(self) -> Column:
        key = quoted(self.column)
        return key.asc_nulls_last() if self.ascending else key.desc_nulls_last()


def orders(keys: Sequence[str | Order] | str | Order) -> list[Order]:
    if isinstance(keys, (str, Order)):
        keys = [keys]
    return [k if isinstance(k, Order) else Order(k) for k in keys]


def sort_columns(keys: Sequence[str | Order] | str | Order) -> list[Column]:
    return [o.sort_column() for o in orders(keys)]


def _range_key(df: DataFrame, keys: list[Order]) -> Column | None:
    """A struct that compares like the sort keys, up to the first key of a type without an order."""
    fields: list[Column] = []
    for i, order in enumerate(keys):
        data_type, column = type_of(df, order.column), quoted(order.column)
        if is_temporal(data_type):
            # Wall-clock types are compared as such, so no time zone can reorder them.
            wall = column if isinstance(data_type, T.TimestampType) else column.cast("timestamp_ntz")
            value = (
                F.unix_micros(wall)
                if isinstance(data_type, T.TimestampType)
                else F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01'"), wall)
            )
        elif is_boolean(data_type):
            value = column.cast("long")
        elif is_integral(data_type):
            value = column.cast("long")
        elif isinstance(data_type, T.DecimalType):
            value = column  # a double would tie or reorder long keys
        elif is_numeric(data_type):
            value = column.cast("double")
        elif is_text(data_type):
            value = column
        elif isinstance(data_type, T.BinaryType):
            value = F.hex(column)
        else:
            break
        if not order.ascending:
            if is_text(data_type) or isinstance(data_type, T.BinaryType):
                # Complemented digits order backwards; the closing G puts a text after its extensions.
                digits = value if isinstance(data_type, T.BinaryType) else F.hex(column)
                value = F.concat(F.translate(digits, "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))
            else:
                fractional = is_numeric(data_type) and not is_integral(data_type)
                value = -value if fractional else F.bitwise_not(value)
        fields += [column.isNull().alias(f"n{i}"), value.alias(f"v{i}")]
    return F.struct(*fields) if fields else None


def literal_array(values: Sequence, element_type: str) -> Column:
    """A constant array built in one step; Spark folds it to a literal."""
    return F.from_json(F.lit(json.dumps(list(values))), f"array<{element_type}>")


def with_range(
    df: DataFrame,
    keys: Sequence[str | Order] | str | Order,
    rows: int | None = None,
    rows_per_range: int = ROWS_PER_RANGE,
) -> tuple[DataFrame, int]:
    """Add ``__range``, a number that never decreases along the sort keys."""
    ordering = orders(keys)
    total = df.count() if rows is None else rows
    wanted = math.ceil(total / rows_per_range) if total else 1
    key = _range_key(df, ordering)
    if wanted <= 1 or key is None:
        return df.withColumn(RANGE, F.lit(0)), 1

    per_range = _SAMPLE_PER_RANGE if wanted <= _WELL_SAMPLED else max(4, _SAMPLE_PER_RANGE * _WELL_SAMPLED // wanted)
    share = min(1.0, wanted * per_range / total)
    # A few keys of each range reach the driver.
    sampled = df.select(key.alias("k")).sample(share, seed=17)
    schema = sampled.schema["k"].dataType.simpleString()
    texts = [r[0] for r in sampled.orderBy("k").select(F.to_json("k", _JSON)).collect()]
    step = max(1, len(texts) // wanted)
    borders = list(dict.fromkeys(texts[step::step]))
    if not borders:
        return df.withColumn(RANGE, F.lit(0)), 1

    if len(borders) <= _FEW_BORDERS:
        fits = [(F.from_json(F.lit(b), schema, _JSON) <= F.col("__key")).cast("int") for b in borders]
        return df.withColumn("__key", key).withColumn(RANGE, sum(fits, F.lit(0))).drop("__key"), len(borders) + 1
    # Binary search over the borders; one expression, so that no rule of Spark's multiplies it.
    table = F.from_json(F.lit("[" + ",".join(borders) + "]"), f"array<{schema}>", _JSON)
    steps = F.array(*[F.lit(1 << n) for n in reversed(range(len(borders).bit_length()))])
    passed = F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: at + F.when(F.get(table, at + step - 1) <= F.col("__key"), step).otherwise(F.lit(0)),
    )
    return df.withColumn("__key", key).withColumn(RANGE, passed).drop("__key"), len(borders) + 1


def range_offsets(ranged: DataFrame, ranges: int, weight: Column | None = None) -> list[int]:
    """Rows (or weight) in all earlier ranges; one number per range."""
    measure = F.count(F.lit(1)) if weight is None else F.sum(weight)
    sizes = dict(ranged.groupBy(RANGE).agg(measure).collect())
    offsets, running = [], 0
    for number in range(ranges):
        offsets.append(running)
        running += int(sizes.get(number) or 0)
    return offsets


def _position(ranged: DataFrame, ranges: int, keys) -> Column:
    local = (F.row_number().over(Window.partitionBy(RANGE).orderBy(*sort_columns(keys))) - 1).cast("long")
    if ranges == 1:
        return local
    offsets = literal_array(range_offsets(ranged, ranges), "bigint")
    return F.element_at(offsets, F.col(RANGE) + 1) + local


def with_position(
    df: DataFrame, keys: Sequence[str | Order] | str | Order, name: str = "__position", **options
) -> DataFrame:
    """Add the 0-based row number along a unique sort key."""
    ranged, ranges = with_range(df, keys, **options)
    return ranged.withColumn(name, _position(ranged, ranges, keys)).drop(RANGE)


def with_neighbours(
    df: DataFrame, column: str, keys: Sequence[str] | str, sides: Sequence[str], positions: bool = False, **options
) -> DataFrame:
    """Add the closest non-missing value before and/or after each row.

    ``sides`` holds "before" and/or "after"; each adds a struct ``__before`` /
    ``__after`` with the value ``v``, NULL where there is none.  ``positions``
    adds the row's own ``__position`` and the position ``p`` of each neighbour.

    Rows are shuffled once, by range.  The cells carried over range borders are
    found before that by plain aggregation, one row per range.
    """
    ordering = orders(keys)
    if not all(o.ascending for o in ordering):
        raise ValueError("Neighbours are looked up along ascending keys.")
    ranged, ranges = with_range(df, ordering, **options)
    carried = _carried_over(ranged, ranges, column, ordering, positions) if ranges > 1 else {}

    within = Window.partitionBy(RANGE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    value = quoted(column)
    if positions:
        ranged = ranged.withColumn("__position", _position(ranged, ranges, ordering))
        cell = F.struct(F.col("__position").alias("p"), value.alias("v"))
    else:
        cell = F.struct(value.alias("v"))
    placed = ranged.withColumn("__seen", F.when(value.isNotNull(), cell))
    for side in sides:
        # "after" runs backwards: a following-rows frame would be quadratic.
        back = side == "after"
        sort = [quoted(o.column).desc_nulls_first() if back else o.sort_column() for o in ordering]
        inside = F.last("__seen", ignorenulls=True).over(within.orderBy(*sort))
        placed = placed.withColumn(f"__{side}", F.coalesce(inside, carried[side]) if carried else inside)
    return placed.drop("__seen", RANGE)




def _constant_cells(texts: list[str | None], struct_type: str) -> Column:
    """Per range, a constant struct given as JSON text."""
    body = "[" + ",".join(t or "null" for t in texts) + "]"
    return F.element_at(F.from_json(F.lit(body), f"array<{struct_type}>", _JSON), F.col(RANGE) + 1)


def _carried_over(
    ranged: DataFrame, ranges: int, column: str, ordering: list[Order], positions: bool
) -> dict[str, Column]:
    """Per range, the nearest filled cell of the earlier and of the later ranges."""
    parts = []
    for i, o in enumerate(ordering):
        key = quoted(o.column)
        parts += [key.isNull().alias(f"n{i}"), key.alias(f"k{i}")]
    cells = ranged.select(RANGE, F.struct(*parts).alias("k"), quoted(column).alias("v"))
    filled = cells.filter(F.col("v").isNotNull())
    ends = (
        filled.groupBy(RANGE)
        .agg(F.min("k").alias("k0"), F.min_by("v", "k").alias("v0"), F.max("k").alias("k1"), F.max_by("v", "k").alias("v1"))
    )
    key_type = cells.schema["k"].dataType.simpleString()
    value_type = cells.schema["v"].dataType.simpleString()
    struct_type = f"struct<v:{value_type}>"
    rows = ends.select(
        RANGE,
        *[F.to_json(F.struct(F.col(f"v{e}").alias("v")), _JSON).alias(f"cell{e}") for e in (0, 1)],
        *[F.to_json(f"k{e}", _JSON).alias(f"key{e}") for e in (0, 1)],
    ).collect()
    found = {r[RANGE]: r for r in rows}
    cell = {(n, e): found[n][f"cell{e}"] if n in found else None for n in range(ranges) for e in (0, 1)}
    if positions:
        struct_type = f"struct<p:bigint,v:{value_type}>"
        offsets = range_offsets(ranged, ranges)
        counts = []
        for e in (0, 1):
            edge = _constant_cells([found[n][f"key{e}"] if n in found else None for n in range(ranges)], key_type)
            counts.append(F.count_if(F.col("k") <= edge).alias(f"r{e}"))
        ranks = {r[RANGE]: r for r in cells.groupBy(RANGE).agg(*counts).collect()}
        for (n, e), text in cell.items():
            if text is not None:
                cell[n, e] = f'{{"p":{offsets[n] + ranks[n][f"r{e}"] - 1},' + text[1:]

    def walk(numbers, end: int) -> list[str | None]:
        nearest, last = {}, None
        for n in numbers:
            nearest[n] = last
            last = cell[n, end] or last
        return [nearest[n] for n in range(ranges)]

    return {
        "before": _constant_cells(walk(range(ranges), 1), struct_type),
        "after": _constant_cells(walk(reversed(range(ranges)), 0), struct_type),
    }


def page_of(
    df: DataFrame,
    keys: Sequence[str | Order] | str | Order,
    offset: int,
    size: int,
    shallow: int = 100_000,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Rows offset .. offset+size-1 along the sort keys.

    Close to the front this is Spark's top-k.  Deep pages first close in on the key
    range that holds the page, so only its rows are sorted.
    """
    ordering = sort_columns(keys)
    if offset + size <= shallow:
        return df.orderBy(*ordering).offset(offset).limit(size)
    total = df.count()
    if offset >= total:
        return df.limit(0)
    near, below = _around(df, orders(keys), offset, size, total, max(4 * size, min(rows_per_range, shallow)))
    return near.orderBy(*ordering).offset(offset - below).limit(size)


def _around(
    df: DataFrame, keys: list[Order], offset: int, size: int, total: int, enough: int
) -> tuple[DataFrame, int]:
    """(rows of a key range that holds the page, number of rows before it).

    A look takes some keys of the range and counts the rows up to two of them around
    the page: two scans with a one-row result, for a range of a few hundredths or less.
    It ends at ``enough`` rows, or where equal keys leave nothing to cut.
    """
    key = _range_key(df, keys)
    if key is None:
        return df, 0
    keyed = df.withColumn("__key", key)
    key_type = keyed.schema["__key"].dataType.simpleString()
    near, below, inside, slack = keyed, 0, total, 4
    while inside > enough:
        texts = (
            near.select(F.col("__key").alias("k"))
            .sample(min(1.0, _KEYS_PER_LOOK / inside), seed=17)
            .agg(F.transform(F.sort_array(F.collect_list("k")), lambda k: F.to_json(k, _JSON)))
            .first()[0]
        )
        borders = []
        for at, way in ((offset - below, -1), (offset + size - below, 1)):
            part = min(1.0, at / inside)
            spread = slack * (1 + math.sqrt(part * (1 - part) * len(texts)))
            place = math.floor(part * len(texts) + way * spread)
            borders.append(F.from_json(F.lit(texts[place]), key_type, _JSON) if 0 <= place < len(texts) else None)
        low, high = borders
        before = F.lit(False) if low is None else F.col("__key") < low
        upto = F.lit(True) if high is None else F.col("__key") <= high
        less, most = near.agg(F.count_if(before), F.count_if(upto)).first()
        starts, ends = offset >= below + less, offset + size <= below + most
        cut = (less if starts else 0) + (inside - most if ends else 0)
        if cut == 0:
            if low is None and high is None or slack > _KEYS_PER_LOOK:
                break
            slack *= 4
            continue
        near = near.filter(~before) if starts else near
        near = near.filter(upto) if ends else near
        inside -= cut
        below += less if starts else 0
    return near.drop("__key"), below
