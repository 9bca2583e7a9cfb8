"""Correlation matrices in long form: (column_x, column_y, correlation)."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from sievework.errors import OperationError
from sievework.functions.columns import as_double, is_numeric, numeric_columns, quoted, require_columns, type_of
from sievework.functions.frequencies import attach
from sievework.functions.ordering import RANGE, with_range
from sievework.session import materialize, temporary

_PAIRS_PER_PASS = 60
#: Columns of so many values get their ranks from arrays in the plan.
_FEW_VALUES = 256
_CELLS_PER_TASK = 1_000_000


def correlation(
    df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson", **options
) -> DataFrame:
    """Every pair of numeric columns over the rows where both are present; constants give NULL."""
    if columns:
        require_columns(df, columns)
        names = [c for c in columns if is_numeric(type_of(df, c))]
    else:
        names = numeric_columns(df)
    if len(names) < 2:
        raise OperationError("Correlation needs at least two numeric columns.")
    wide = df.select([as_double(df, c).alias(f"x{i}") for i, c in enumerate(names)])
    pairs = list(itertools.combinations_with_replacement(range(len(names)), 2))
    if method == "pearson":
        cells = _pearson(wide, pairs)
    elif method in ("spearman", "kendall"):
        cells = _pearson(wide, [(i, i) for i in range(len(names))])
        apart = list(itertools.combinations(range(len(names)), 2))
        rank = _spearman if method == "spearman" else _kendall
        cells = cells.unionByName(rank(wide, apart, **options))
    else:
        raise OperationError(f"Unknown correlation method '{method}'.")
    labels = F.array(*[F.lit(n) for n in names])
    both = cells.select(
        F.explode(
            F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(
                F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
            )
        ).alias("p"),
        "correlation",
    )
    return both.select(
        F.element_at(labels, F.col("p.i") + 1).alias("column_x"),
        F.element_at(labels, F.col("p.j") + 1).alias("column_y"),
        "correlation",
    )


def _pearson(
    wide: DataFrame, pairs: list[tuple[int, int]], labels: list[tuple[int, int]] | None = None, same_rows: bool = False
) -> DataFrame:
    """All pairs in one aggregation (a few for very wide tables); no shuffle but the totals.

    ``labels`` are given out as ``i, j`` in place of the columns' numbers.  The spread of a
    column without gaps is summed once for all its pairs; ``same_rows`` tells that the two
    columns of every pair have their gaps in the same rows, which comes to the same.
    """
    apart = any(i != j for i, j in pairs)
    whole = set(range(len(wide.columns)) if same_rows else _columns_without_gaps(wide) if apart else [])
    parts = None
    for at in range(0, len(pairs), _PAIRS_PER_PASS):
        some = list(zip(pairs, labels or pairs))[at : at + _PAIRS_PER_PASS]
        aggregates, cells = {}, []
        for n, ((i, j), named) in enumerate(some):
            x, y = F.col(f"x{i}"), F.col(f"x{j}")
            if i == j:
                aggregates[f"v{i}"] = F.var_pop(x)
                r = F.when(F.col(f"v{i}") > 0, F.lit(1.0))
            else:
                aggregates[f"c{n}"] = F.covar_pop(x, y)
                if i in whole and j in whole:
                    spreads = {f"v{i}": F.var_pop(x), f"v{j}": F.var_pop(y)}
                else:
                    spreads = {f"a{n}": F.var_pop(F.when(y.isNotNull(), x)), f"b{n}": F.var_pop(F.when(x.isNotNull(), y))}
                aggregates |= spreads
                r = _ratio(f"c{n}", *spreads)
            cells.append(F.struct(F.lit(named[0]).alias("i"), F.lit(named[1]).alias("j"), r.alias("correlation")))
        row = wide.agg(*[a.alias(name) for name, a in aggregates.items()])
        part = row.select(F.inline(F.array(*cells)))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def _ratio(both: str, first: str, second: str) -> Column:
    r = F.try_divide(F.col(both), F.sqrt(first) * F.sqrt(second))
    return F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def _columns_without_gaps(wide: DataFrame) -> list[int]:
    row = wide.agg(F.count(F.lit(1)), *[F.count(c) for c in wide.columns]).first()
    return [i for i, n in enumerate(row[1:]) if n == row[0]]


def _ranked(wide: DataFrame, values: Sequence[Column], measure: str = "rank", **options) -> DataFrame:
    """``x0, x1, ...``: each value's average rank ("rank") or number from 0 ("dense") among those of its column.

    Values of all columns are counted once.  The ranks of a column of few values stand in the
    plan.  Other columns are ranked together: (column, value) is cut into ranges and numbered
    once, and ranks go back to the cells of every such column in one join, then to their rows
    by a row key.  So exchanges do not grow with the columns.
    """
    table = wide.select([v.alias(f"x{k}") for k, v in enumerate(values)])
    some = F.array(*[F.struct(F.lit(k).alias("id"), F.col(f"x{k}").alias("v")) for k in range(len(values))])
    cells = table.select(F.explode(some).alias("key")).select("key.*").filter(F.col("v").isNotNull())
    counts = materialize(cells.groupBy("id", "v").agg(F.count(F.lit(1)).alias("t")), "values")
    totals = counts.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("filled")).collect()
    sizes, filled = ({r["id"]: r[c] for r in totals} for c in ("n", "filled"))
    many = sorted(k for k, n in sizes.items() if n > _FEW_VALUES)
    known = {k: ([], [], []) for k in sizes if k not in many}
    for k, v, t in counts.filter(F.col("id").isin(list(known))).orderBy("id", "v").collect():
        found, ranks, times = known[k]
        ranks.append(sum(times) + t - (t - 1) / 2 if measure == "rank" else float(len(found)))
        found.append(v)
        times.append(t)
    settled = {
        k: F.get(F.array(*map(F.lit, ranks)), F.array_position(F.array(*map(F.lit, found)), F.col(f"x{k}")).cast("int") - 1)
        for k, (found, ranks, _) in known.items()
    }
    ready = [settled.get(k, F.lit(None).cast("double")).alias(f"x{k}") for k in range(len(values)) if k not in many]
    names = [f"x{k}" for k in range(len(values))]
    if not many:
        return table.select(*ready)

    counts = counts.filter(F.col("id").isin(many))
    ranged, ranges = with_range(counts, ["id", "v"], **options)
    inside = Window.partitionBy(RANGE, "id").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.sum("t") if measure == "rank" else F.count(F.lit(1))
    placed = ranged.withColumn("upto", upto.over(inside))
    if ranges > 1:  # a row per range and column that it holds
        earlier = Window.partitionBy("id").orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
        before = ranged.groupBy(RANGE, "id").agg(upto.alias("own")).select(RANGE, "id", F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("before"))
        placed = placed.join(before, [RANGE, "id"]).withColumn("upto", F.col("upto") + F.col("before"))
    value = F.col("upto") - (F.col("t") - 1) / 2 if measure == "rank" else (F.col("upto") - 1).cast("double")
    lookup = placed.select(F.struct("id", "v").alias("key"), value.alias("value"), F.col("t").alias("n"))

    keys = {k: F.when(F.col(f"x{k}").isNotNull(), F.struct(F.lit(k).alias("id"), F.col(f"x{k}").alias("v"))) for k in many}
    if len(many) == 1:
        return attach(table.select(keys[many[0]].alias("key"), *ready), "key", lookup, f"x{many[0]}").select(
            [F.col(f"x{many[0]}" if c == f"x{many[0]}" else c) for c in names]
        )
    cell = F.explode(F.array(*[F.struct(F.lit(k).alias("id"), keys[k].alias("key")) for k in many])).alias("cell")
    # The first cell of a row carries what is settled.
    cells = table.select(*ready, *[F.col(f"x{k}").alias(f"x{k}") for k in many]).withColumn("row", F.monotonically_increasing_id())
    cells = cells.select("row", cell, *[f"x{k}" for k in range(len(values)) if k not in many])
    first = F.col("cell.id") == many[0]
    cells = cells.filter(first | F.col("cell.key").isNotNull()).select(
        "row", "cell.id", "cell.key", *[F.when(first, F.col(f"x{k}")).alias(f"x{k}") for k in range(len(values)) if k not in many]
    )
    # So many tasks that the rows which one of them puts together stay few.
    tasks = math.ceil(sum(filled[k] for k in many) / _CELLS_PER_TASK)
    found = attach(cells, "key", lookup, "found").repartition(tasks, "row")
    return found.groupBy("row").agg(
        *[F.max(F.when(F.col("id") == k, F.col("found")) if k in many else F.col(f"x{k}")).alias(f"x{k}") for k in range(len(values))]
    )


def _spearman(wide: DataFrame, pairs: list[tuple[int, int]], **options) -> DataFrame:
    """Pearson on average ranks.  A pair with gaps is ranked over the rows that have both, as columns of its own."""
    whole = _columns_without_gaps(wide)
    values, at = [F.col(f"x{i}") for i in whole], []
    for i, j in pairs:
        if i in whole and j in whole:
            at.append((whole.index(i), whole.index(j)))
            continue
        x, y = F.col(f"x{i}"), F.col(f"x{j}")
        at.append((len(values), len(values) + 1))
        values += [F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)]
    return _pearson(_ranked(wide, values, **options), at, pairs, same_rows=True)


def _kendall(wide: DataFrame, pairs: list[tuple[int, int]], **options) -> DataFrame:
    """Tau-b of all pairs at once."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("pair"), F.col(f"x{i}").alias("x"), F.col(f"x{j}").alias("y")) for n, (i, j) in enumerate(pairs)]))
    present = wide.select(each.alias("p")).select("p.*").filter("x is not null and y is not null")
    counts = present.groupBy("pair", "x", "y").agg(F.count(F.lit(1)).alias("w"))
    with temporary(counts, "pairs") as counts:  # read several times
        found = {r["pair"]: r["r"] for r in _tau(counts, **options).collect()}
    rows = [(i, j, found.get(n)) for n, (i, j) in enumerate(pairs)]
    return wide.sparkSession.createDataFrame(rows, "i int, j int, correlation double")


def _discordant(values: np.ndarray, weights: np.ndarray) -> int:
    """The sum of ``weights[a] * weights[b]`` over a < b with ``values[a] > values[b]``.

    Two ranks first differ at some binary digit; there, among those sharing the higher
    digits, every 1 placed before a 0 is one such pair.
    """
    ranks = np.unique(values, return_inverse=True)[1]
    weights = weights if int(weights.sum()) < 1 << 31 else weights.astype(object)
    places, bad = np.arange(len(ranks)), 0
    for digit in reversed(range(int(ranks.max()).bit_length())):
        prefix, one = ranks >> (digit + 1), (ranks >> digit) & 1
        starts = np.flatnonzero(np.r_[True, prefix[1:] != prefix[:-1]])
        sizes = np.diff(np.r_[starts, len(ranks)])
        within = lambda x: np.cumsum(x) - x - np.repeat((np.cumsum(x) - x)[starts], sizes)
        bad += int((within(weights * one) * (weights * (1 - one))).sum())
        # Zeros before ones under every prefix, else in the same order.
        start = np.repeat(starts, sizes)
        passed, zeros = within(one), np.repeat(np.add.reduceat(1 - one, starts), sizes)
        to = start + np.where(one == 1, zeros + passed, places - start - passed)
        ranks[to], weights[to] = ranks.copy(), weights.copy()
    return bad


def _tau(counts: DataFrame, **options) -> DataFrame:
    """``pair, r`` by counting discordant pairs; no pair of rows is ever formed.

    ``counts`` holds ``pair, x, y, w``.  Rows are cut into ranges along (x, y) and also
    along (y, x).  Of a discordant pair, the rows lie in one range along (y, x), or else
    in one range along (x, y), or in neither: each is counted where it lies, the last
    kind on the number of rows per two ranges.
    """
    total = counts.count()
    across = with_range(counts, ["pair", "x", "y"], total, **options)[0].withColumnRenamed(RANGE, "a")
    both = with_range(across, ["pair", "y", "x"], total, **options)[0].withColumnRenamed(RANGE, "b")

    def counted(rows: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
        def count(part: pd.DataFrame) -> pd.DataFrame:
            part = part.iloc[np.lexsort([part[c].to_numpy() for c in reversed(order)])]
            bad = _discordant(part[value].to_numpy(), part["w"].to_numpy())
            return pd.DataFrame({"pair": part["pair"].iloc[:1], "bad": [str(bad)]})

        needed = dict.fromkeys(["pair", *group, *order, value, "w"])
        return rows.select(*needed).groupBy("pair", *group).applyInPandas(count, "pair int, bad string")

    with temporary(both, "pairs") as both:
        grid = both.groupBy("pair", "a", "b").agg(F.sum("w").alias("w"))
        bad = (
            counted(both, ["b"], ["x", "y"], "y")
            .unionByName(counted(both, ["a"], ["x", "y"], "b"))
            .unionByName(counted(grid, [], ["a", "b"], "b"))
            .groupBy("pair")
            .agg(F.sum(F.col("bad").cast("decimal(38,0)")).cast("double").alias("bad"))
            .collect()
        )
    bad = counts.sparkSession.createDataFrame(bad, "pair int, bad double")

    def tied(name: str, *columns: str) -> DataFrame:
        totals = counts.groupBy("pair", *columns).agg(F.sum("w").alias("w")) if len(columns) < 2 else counts
        t = F.col("w").cast("decimal(19,0)")
        return totals.groupBy("pair").agg(F.sum((t * (t - 1) / 2).cast("decimal(38,0)")).cast("double").alias(name))

    # A row for each pair of columns.
    totals = bad
    for part in (tied("n0"), tied("n1", "x"), tied("n2", "y"), tied("n3", "x", "y")):
        totals = totals.join(part, "pair")
    numerator = F.col("n0") - F.col("n1") - F.col("n2") + F.col("n3") - 2 * F.col("bad")
    spread_x, spread_y = F.col("n0") - F.col("n1"), F.col("n0") - F.col("n2")
    r = F.try_divide(numerator, F.sqrt(spread_x) * F.sqrt(spread_y))
    return totals.select("pair", F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("r"))


def correlation_wide(long: DataFrame, names: Sequence[str], digits: int = 4) -> DataFrame:
    """The matrix as a table: one row per variable, one column per variable."""
    return (
        long.groupBy(F.col("column_x").alias("variable"))
        .pivot("column_y", list(names))
        .agg(F.first(F.round("correlation", digits)))
        .select("variable", *[quoted(n) for n in names])
    )
