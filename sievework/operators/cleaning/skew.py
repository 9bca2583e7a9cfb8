"""Power transforms against skew."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from sievework.errors import OperationError
from sievework.functions.columns import as_double, put, quoted
from sievework.functions.moments import skewness
from sievework.operators.cleaning.base import Operation
from sievework.operators.cleaning.extremes import above_minus_one, log1p, minimum
from sievework.operators.cleaning.scaling import scaled

_WIDEST = 64.0


def _not_negative(name: str, params, facts) -> None:
    if facts["min"] is not None and facts["min"] < 0:
        raise OperationError(f"A square root transform needs values of at least 0 in '{name}'.")


def _scores(rows: DataFrame, transform: Callable[[Column, Column], Column], grid: list[float]) -> list[float]:
    """The log-likelihood at each power of the grid: one scan, one total per power is shuffled."""
    spreads = [F.nullif(F.var_pop(transform(F.col("x"), F.lit(float(p)))), F.lit(0.0)) for p in grid]
    scores = [-F.count("x") / 2 * F.log(v) + (p - 1) * F.sum("j") for v, p in zip(spreads, grid)]
    scored = rows.agg(*[s.alias(f"s{i}") for i, s in enumerate(scores)]).first()
    found = [-math.inf] * len(grid)
    for i, score in enumerate(scored):
        if score is not None and not math.isnan(score):
            found[i] = score
    return found


def best_power(rows: DataFrame, transform: Callable[[Column, Column], Column]) -> float:
    """The power of highest likelihood for ``rows`` (x, j = log-Jacobian of x).

    A grid of powers brackets the maximum; the vertex of the parabola through
    its three best points is the centre of the next grid, 32 times as fine.
    Three scans give about eight digits.
    """
    known = rows.filter(F.col("x").isNotNull())
    centre, step, half = 0.0, 0.125, 16
    for _ in range(40):
        grid = [centre + step * i for i in range(-half, half + 1)]
        scores = _scores(known, transform, grid)
        best = max(range(len(grid)), key=scores.__getitem__)
        if scores[best] == -math.inf:
            return 1.0
        centre = grid[best]
        if not 0 < best < len(grid) - 1:
            if abs(centre) > _WIDEST:
                return centre
            step *= 4  # the maximum lies outside: move and widen
            continue
        if -math.inf in (scores[best - 1], scores[best + 1]):
            step /= 2  # powers next to the best one overflow: close in
            continue
        left, middle, right = scores[best - 1 : best + 2]
        bend = left - 2 * middle + right
        if bend < 0:
            centre += step * (left - right) / (2 * bend)
        if step < 2e-4 or bend >= 0:
            return centre
        step, half = step / 32, 8
    return centre


def box_cox(x: Column, power: Column) -> Column:
    return F.when(F.abs(power) < 1e-9, F.log(x)).otherwise((F.pow(x, power) - 1) / power)


def yeo_johnson(x: Column, power: Column) -> Column:
    rest = F.lit(2.0) - power
    up = F.when(F.abs(power) < 1e-9, F.log1p(x)).otherwise((F.pow(x + 1, power) - 1) / power)
    down = F.when(F.abs(rest) < 1e-9, -F.log1p(-x)).otherwise(-(F.pow(1 - x, rest) - 1) / rest)
    return F.when(x >= 0, up).otherwise(down)


def _boxcox_fit(df: DataFrame, name: str, params) -> dict:
    x = as_double(df, name)
    row = df.agg(F.min(x).alias("min"), F.avg(F.when(x > 0, F.log(x))).alias("log")).first()
    if row["min"] is None:
        return {"power": 1.0}
    if row["min"] <= 0:
        raise OperationError(f"Box-Cox needs values above 0 in '{name}'.")
    # Over its geometric mean x has no log-Jacobian left, and powers stay in range.
    rows = df.select((x / math.exp(row["log"])).alias("x"), F.lit(0.0).alias("j"))
    return {"power": best_power(rows, box_cox)}


def _yeojohnson_fit(df: DataFrame, name: str, params) -> dict:
    x = as_double(df, name)
    rows = df.select(x.alias("x"), (F.signum(x) * F.log1p(F.abs(x))).alias("j"))
    power = best_power(rows, yeo_johnson)
    y = yeo_johnson(x, F.lit(power))
    row = df.agg(F.avg(y), F.stddev_pop(y)).first()
    return {"power": power, "mean": row[0], "sd": row[1]}


def _yeojohnson(df: DataFrame, name: str, params, facts) -> DataFrame:
    bent = put(df, name, yeo_johnson(as_double(df, name), F.lit(facts["power"])))
    return scaled(bent, name, facts["mean"], facts["sd"])


def _filled(df, name, params, facts) -> Column:
    return F.count(quoted(name))


def skew_change(before: DataFrame, after: DataFrame, name: str) -> DataFrame:
    """One row: skewness of a column before and after a transform."""
    return before.agg(skewness(as_double(before, name)).alias("skewness_before")).select(
        "skewness_before",
        after.agg(skewness(as_double(after, name))).scalar().alias("skewness_after"),
    )


_SKEWNESS = {
    when: lambda df, c, p, name=f"skewness_{when}": {name: skewness(as_double(df, c))} for when in ("before", "after")
}

OPERATIONS = [
    Operation(
        "skew.log_transform",
        "Log Transform",
        log1p,
        statistics=minimum,
        verify=above_minus_one,
        numbers_only=True,
        **_SKEWNESS,
    ),
    Operation(
        "skew.sqrt_transform",
        "Square Root Transform",
        lambda df, c, p, f: put(df, c, F.sqrt(as_double(df, c))),
        statistics=minimum,
        verify=_not_negative,
        numbers_only=True,
        **_SKEWNESS,
    ),
    Operation(
        "skew.boxcox",
        "Box-Cox",
        lambda df, c, p, f: put(df, c, box_cox(as_double(df, c), F.lit(f["power"]))),
        learn=_boxcox_fit,
        affected=_filled,
        numbers_only=True,
        **_SKEWNESS,
    ),
    Operation(
        "skew.yeojohnson",
        "Yeo-Johnson",
        _yeojohnson,
        learn=_yeojohnson_fit,
        affected=_filled,
        numbers_only=True,
        **_SKEWNESS,
    ),
]
