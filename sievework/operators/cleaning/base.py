"""What a cleaning operation is: a little to learn from the table, and a lazy rewrite of it.

Learning is kept to a bounded result (a row of statistics, a list of
categories), the way an ML estimator is fitted; the rewrite then is an ordinary
DataFrame expression, so a chain of operations stays one linear plan.
Statistics are declared rather than computed by each operation, so a chain can
learn many of them in one scan (see ``plans.cleaning``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from sievework.errors import OperationError, UnknownOperationError
from sievework.functions.columns import is_boolean, is_numeric, quoted, type_of

Params = Mapping[str, Any]
Facts = dict[str, Any]


@dataclass(frozen=True)
class OperationSpec:
    """One step: which operation, on which column, with which parameters."""

    operation_key: str
    column_name: str | None = None
    params: Params = field(default_factory=dict)


@dataclass(frozen=True)
class Operation:
    """A named operation; only ``rewrite`` is required.

    ``statistics``  one-row aggregates to learn, by name
    ``quantiles``   quantiles of the column to learn (fact ``quantiles``)
    ``learn``       anything needing its own passes
    ``verify``      raises when the facts rule the operation out
    ``affected``    aggregate counting the rows it changes
    ``before``, ``after``  further aggregates for the account of the step, over the table before and after it
    """

    key: str
    label: str
    rewrite: Callable[[DataFrame, str, Params, Facts], DataFrame]
    statistics: Callable[[DataFrame, str, Params], dict[str, Column]] | None = None
    quantiles: Callable[[Params], list[float]] | None = None
    learn: Callable[[DataFrame, str, Params], Facts] | None = None
    verify: Callable[[str, Params, Facts], None] | None = None
    affected: Callable[[DataFrame, str, Params, Facts], Column] | None = None
    measure: Callable[[DataFrame, str, Params, Facts], DataFrame] | None = None
    columns_changed: Callable[[DataFrame, str, Facts], int] | None = None
    numbers_only: bool = False
    whole_table: bool = False
    drops_rows: bool = False
    reads: Callable[[DataFrame, str, Params], Iterable[str]] | None = None
    before: Callable[[DataFrame, str, Params], dict[str, Column]] | None = None
    after: Callable[[DataFrame, str, Params], dict[str, Column]] | None = None

    @property
    def category(self) -> str:
        return self.key.split(".", 1)[0]

    @property
    def row_local(self) -> bool:
        """True if a row's result depends on that row alone (also fine on a stream)."""
        return not (self.statistics or self.quantiles or self.learn or self.whole_table)

    def check(self, df: DataFrame, spec: OperationSpec) -> None:
        if self.whole_table:
            return
        name = spec.column_name
        if not name or name not in df.columns:
            raise OperationError(f"Column '{name}' is not in this table.")
        data_type = type_of(df, name)
        if self.numbers_only and not (is_numeric(data_type) or is_boolean(data_type)):
            raise OperationError(f"Column '{name}' is not numeric.")


@dataclass
class Outcome:
    """The rewritten table, and a one-row account of the step (computed when asked for)."""

    spec: OperationSpec
    dataframe: DataFrame
    _metrics: Callable[[], DataFrame]
    before: DataFrame | None = None

    @property
    def metrics(self) -> DataFrame:
        return self._metrics()


METRICS_SCHEMA = (
    "operation_key string, column_name string, affected_row_count long, affected_column_count long"
)


def affected_rows(op: Operation, df: DataFrame, name: str, params: Params, facts: Facts) -> Column:
    affected = op.affected or (lambda *_: F.count(F.lit(1)))
    return affected(df, name, params, facts).cast("long")


def metrics_of(op: Operation, spec: OperationSpec, before: DataFrame, facts: Facts) -> DataFrame:
    """operation_key, column_name, affected_row_count, affected_column_count."""
    name, params = spec.column_name, spec.params
    if op.measure is not None:
        counted = op.measure(before, name, params, facts)
    else:
        counted = before.agg(affected_rows(op, before, name, params, facts).alias("affected_row_count"))
    changed = op.columns_changed(before, name, facts) if op.columns_changed else 1
    return counted.select(
        F.lit(spec.operation_key).alias("operation_key"),
        F.lit(name).cast("string").alias("column_name"),
        "affected_row_count",
        F.lit(changed).cast("long").alias("affected_column_count"),
    )


class Catalog:
    """Operations by key.  Add your own with ``register``."""

    def __init__(self, operations: Iterable[Operation] = ()) -> None:
        self._operations: dict[str, Operation] = {}
        for operation in operations:
            self.register(operation)

    def register(self, operation: Operation) -> None:
        self._operations[operation.key] = operation

    def get(self, key: str) -> Operation:
        if key not in self._operations:
            raise UnknownOperationError(f"No cleaning operation '{key}'.")
        return self._operations[key]

    def all(self, category: str | None = None) -> list[Operation]:
        return [o for o in self._operations.values() if category in (None, o.category)]

    def table(self, spark, category: str | None = None) -> DataFrame:
        """key, label, category of every operation."""
        return spark.createDataFrame(
            [(o.key, o.label, o.category) for o in self.all(category)],
            "key string, label string, category string",
        )


def count_missing(df: DataFrame, name: str, params: Params, facts: Facts) -> Column:
    return F.count_if(quoted(name).isNull())
