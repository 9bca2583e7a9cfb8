"""Exact quantiles (linear interpolation) that do not hold a column in one task.

Spark's ``percentile`` keeps every distinct value of a group in one aggregation
state.  That is fine, and used, while the number of values is small.  Beyond
that, ``exact_quantiles`` closes in on the wanted order statistics: an
approximate quantile brackets each one, counts verify the bracket, and the next
look is restricted to the bracket.  Every pass is a scan with a one-row result;
no pass shuffles the column.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from sievework.functions.columns import as_double, quoted
from sievework.functions.ordering import RANGE, with_range
from sievework.session import materialize

ONE_STATE_VALUES = 1_000_000
_VALUES_PER_PASS = 8_000_000
_SORTED_VALUES = 250_000
_ACCURACY = 10_000
#: One look holds at most about so many values in a task, and so many expressions.
_HELD_PER_LOOK = 2_000_000
_TARGETS_PER_LOOK = 60


@dataclass
class _Target:
    """One order statistic being located inside an open bracket (lo, hi)."""

    column: str
    rank: int
    inside: int
    below: int = 0
    lo: float | None = None
    hi: float | None = None
    value: float | None = None
    slack: int = 2
    guess: tuple[float, float] | None = field(default=None, repr=False)

    def within(self, x: Column) -> Column:
        condition = x.isNotNull()
        if self.lo is not None:
            condition = condition & (x > self.lo)
        if self.hi is not None:
            condition = condition & (x < self.hi)
        return condition


def exact_quantiles(
    df: DataFrame,
    wanted: Mapping[str, Sequence[float]],
    counts: Mapping[str, int] | None = None,
    one_state: int = ONE_STATE_VALUES,
) -> dict[str, list[float | None]]:
    """Quantiles per column; NULL cells are skipped, an empty column gives None."""
    if not wanted:
        return {}
    values = {c: as_double(df, c) for c in wanted}
    if counts is None:
        row = df.agg(*[F.count(quoted(c)).alias(f"c{i}") for i, c in enumerate(wanted)]).first()
        counts = {c: row[f"c{i}"] for i, c in enumerate(wanted)}

    found: dict[str, list[float | None]] = {c: [None] * len(p) for c, p in wanted.items()}
    small = [c for c in wanted if 0 < counts[c] <= one_state]
    while small:
        batch, held = [], 0
        while small and (not batch or held + counts[small[0]] <= _VALUES_PER_PASS):
            held += counts[small[0]]
            batch.append(small.pop(0))
        row = df.agg(
            *[
                F.percentile(values[c], F.array(*[F.lit(float(p)) for p in wanted[c]])).alias(f"q{i}")
                for i, c in enumerate(batch)
            ]
        ).first()
        for i, c in enumerate(batch):
            found[c] = list(row[f"q{i}"])

    large = [c for c in wanted if counts[c] > one_state]
    targets: dict[tuple[str, int], _Target] = {}
    for c in large:
        for p in wanted[c]:
            position = p * (counts[c] - 1)
            for rank in {math.floor(position), math.ceil(position)}:
                targets[c, rank] = _Target(c, rank, counts[c])
    _locate(df, values, list(targets.values()), min(one_state, _SORTED_VALUES))
    for c in large:
        for i, p in enumerate(wanted[c]):
            position = p * (counts[c] - 1)
            low = targets[c, math.floor(position)].value
            high = targets[c, math.ceil(position)].value
            found[c][i] = low + (high - low) * (position - math.floor(position))
    return found


def _looks(targets: list[_Target], sortable: int) -> Iterator[list[_Target]]:
    """Targets in groups whose sorted values and sketches fit one aggregate; those of a column stay together."""
    group, held = [], 0
    for t in targets:
        size = t.inside if t.inside <= sortable else _ACCURACY
        if group and (held + size > _HELD_PER_LOOK or len(group) == _TARGETS_PER_LOOK):
            yield group
            group, held = [], 0
        group.append(t)
        held += size
    if group:
        yield group


def _locate(df: DataFrame, values: Mapping[str, Column], targets: list[_Target], sortable: int) -> None:
    open_targets = targets
    while open_targets:
        for group in _looks(open_targets, sortable):
            _look(df, values, group, sortable)
        open_targets = [t for t in open_targets if t.value is None]


def _look(df: DataFrame, values: Mapping[str, Column], targets: list[_Target], sortable: int) -> None:
    """Find or narrow down each target: sort what is small, bracket what is not."""
    names = {t.column for t in targets}
    near = df.select([values[c].alias(c) for c in names])
    # Only rows inside some bracket are read on; Spark pushes the ranges to the scan.
    keep = None
    for t in targets:
        condition = t.within(quoted(t.column))
        keep = condition if keep is None else keep | condition
    near = near.filter(keep)

    looks = []
    for i, t in enumerate(targets):
        x = F.when(t.within(quoted(t.column)), quoted(t.column))
        local = t.rank - t.below
        if t.inside <= sortable:
            look = F.array(F.element_at(F.array_sort(F.collect_list(x)), local + 1))
        else:
            reach = t.slack * max(1.0, t.inside / _ACCURACY)
            low = max(0.0, (local - reach) / t.inside)
            high = min(1.0, (local + reach) / t.inside)
            look = F.percentile_approx(x, [low, high], _ACCURACY)
        looks.append(look.alias(f"l{i}"))
    row = near.agg(*looks).first()

    checks, pending = [], []
    for i, t in enumerate(targets):
        if t.inside <= sortable:
            t.value = row[f"l{i}"][0]
            continue
        t.guess = (row[f"l{i}"][0], row[f"l{i}"][1])
        x, (lo, hi) = quoted(t.column), t.guess
        inside = t.within(x)
        n = len(pending)
        pending.append(t)
        checks += [
            F.count_if(inside & (x < lo)).alias(f"b{n}"),
            F.count_if(inside & (x == lo)).alias(f"lo{n}"),
            F.count_if(inside & (x > lo) & (x < hi)).alias(f"in{n}"),
            F.count_if(inside & (x == hi)).alias(f"hi{n}"),
        ]
    if not pending:
        return
    row = near.agg(*checks).first()
    for n, t in enumerate(pending):
        _narrow(t, row[f"b{n}"], row[f"lo{n}"], row[f"in{n}"], row[f"hi{n}"])


def _narrow(t: _Target, below: int, at_lo: int, between: int, at_hi: int) -> None:
    """Use verified counts to fix the value or shrink the bracket."""
    lo, hi = t.guess
    local = t.rank - t.below
    if local < below:
        t.hi, t.inside = lo, below
    elif local < below + at_lo:
        t.value = lo
    elif local < below + at_lo + between:
        t.lo, t.hi = lo, hi
        t.below += below + at_lo
        t.inside = between
    elif local < below + at_lo + between + (at_hi if hi > lo else 0):
        t.value = hi
    else:
        passed = below + at_lo + between + (at_hi if hi > lo else 0)
        t.lo, t.below = hi, t.below + passed
        t.inside -= passed


def grouped_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    column: str,
    wanted: Mapping[str, float],
    rows: int | None = None,
    one_state: int = ONE_STATE_VALUES,
) -> DataFrame:
    """One row per key with exact quantiles named as in ``wanted``.

    A group may hold most of the table, so beyond ``one_state`` rows each group
    is cut into value ranges: counts per (key, range) tell which range holds the
    wanted rank, and only those ranges are ordered.
    """
    total = df.count() if rows is None else rows
    x = as_double(df, column)
    if total <= one_state:
        return df.groupBy(*[quoted(k) for k in keys]).agg(
            *[F.percentile(x, F.lit(float(p))).alias(name) for name, p in wanted.items()]
        )

    groups = [quoted(k) for k in keys]
    # Written once: it is read for the range borders, the range sizes and the ranks.
    counted = materialize(
        df.select(*groups, x.alias("__x")).groupBy(*groups, "__x").agg(F.count(F.lit(1)).alias("__c")),
        "counts",
    )
    different = counted.count()
    if different <= one_state:
        return counted.groupBy(*groups).agg(
            *[F.percentile("__x", F.lit(float(p)), F.col("__c")).alias(name) for name, p in wanted.items()]
        )
    ranged, _ = with_range(counted, "__x", rows=different, rows_per_range=one_state)
    by_key = Window.partitionBy(*groups)
    present = F.sum(F.when(F.col("__x").isNotNull(), F.col("__c")))
    sizes = (
        ranged.groupBy(*groups, RANGE)
        .agg(F.coalesce(present, F.lit(0)).alias("__size"))
        .withColumn("__n", F.sum("__size").over(by_key))
        .withColumn(
            "__start",
            F.coalesce(
                F.sum("__size").over(by_key.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ),
        )
    )
    ranks = {
        name: (
            F.floor(F.lit(float(p)) * (F.col("__n") - 1)),
            F.ceil(F.lit(float(p)) * (F.col("__n") - 1)),
        )
        for name, p in wanted.items()
    }
    holds = None
    for pair in ranks.values():
        for rank in pair:
            hit = (rank >= F.col("__start")) & (rank < F.col("__start") + F.col("__size"))
            holds = hit if holds is None else holds | hit
    left, right = ranged.alias("v"), sizes.filter(holds).alias("s")
    same = F.col(f"v.{RANGE}") == F.col(f"s.{RANGE}")
    for k in keys:
        name = "`" + k.replace("`", "``") + "`"
        same = same & F.col(f"v.{name}").eqNullSafe(F.col(f"s.{name}"))
    joined = left.join(right, same).select("v.*", "s.__n", "s.__start")
    inside = (
        Window.partitionBy(*groups, RANGE)
        .orderBy("__x")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = joined.filter(F.col("__x").isNotNull()).withColumn(
        "__end", F.col("__start") + F.sum("__c").over(inside)
    )
    picks = []
    for name, p in wanted.items():
        low, high = ranks[name]
        at = lambda rank: F.max(
            F.when((rank < F.col("__end")) & (rank >= F.col("__end") - F.col("__c")), F.col("__x"))
        )
        share = F.max(F.lit(float(p)) * (F.col("__n") - 1) - low)
        picks.append((at(low) + (at(high) - at(low)) * share).alias(name))
    picked = placed.groupBy(*groups).agg(*picks)
    everyone = counted.select(*groups).distinct()
    return null_safe_join(everyone, picked, keys)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on ``keys`` where NULL matches NULL; key columns come from the left."""
    a, b = left.alias("a"), right.alias("b")
    condition = None
    for k in keys:
        name = "`" + k.replace("`", "``") + "`"
        part = F.col(f"a.{name}").eqNullSafe(F.col(f"b.{name}"))
        condition = part if condition is None else condition & part
    extra = [F.col("b.`" + c.replace("`", "``") + "`") for c in right.columns if c not in keys]
    return a.join(b, condition, how).select("a.*", *extra)
