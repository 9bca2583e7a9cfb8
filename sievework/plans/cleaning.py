"""Chains of cleaning operations: run, preview, apply as a version."""

from __future__ import annotations

import threading
import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, functions as F

from sievework.functions.columns import nan_to_null
from sievework.functions.quantiles import exact_quantiles
from sievework.operators.cleaning import duplicates, encoding, extremes, missing, scaling, skew, text, types
from sievework.operators.cleaning.base import (
    METRICS_SCHEMA,
    Catalog,
    Facts,
    Operation,
    OperationSpec,
    Outcome,
    affected_rows,
    metrics_of,
)
from sievework.plans.profile import build_profile


def default_catalog() -> Catalog:
    """All built-in operations."""
    return Catalog(
        o
        for module in (missing, duplicates, types, extremes, encoding, scaling, skew, text)
        for o in module.OPERATIONS
    )


@dataclass
class ChainResult:
    dataframe: DataFrame
    outcomes: list[Outcome]

    def metrics(self, spark) -> DataFrame:
        """One row per step: step, operation_key, column_name, affected rows and columns."""
        out = spark.createDataFrame([], "step int, " + METRICS_SCHEMA)
        for i, outcome in enumerate(self.outcomes):
            out = out.unionByName(outcome.metrics.select(F.lit(i + 1).alias("step"), "*"))
        return out


def _learn(df: DataFrame, batch: Sequence[tuple[Operation, OperationSpec]]) -> list[Facts]:
    """Facts of several operations from the same table: one scan for all statistics."""
    facts: list[Facts] = [{} for _ in batch]
    aggregates, owners = [], []
    for i, (op, spec) in enumerate(batch):
        if op.statistics:
            for name, value in op.statistics(df, spec.column_name, spec.params).items():
                aggregates.append(value.alias(f"a{len(aggregates)}"))
                owners.append((i, name))
    if aggregates:
        row = df.agg(*aggregates).first()
        for n, (i, name) in enumerate(owners):
            facts[i][name] = row[n]
    wanted: dict[str, list[float]] = {}
    for op, spec in batch:
        if op.quantiles:
            known = wanted.setdefault(spec.column_name, [])
            known += [p for p in op.quantiles(spec.params) if p not in known]
    if wanted:
        found = exact_quantiles(df, wanted)
        for i, (op, spec) in enumerate(batch):
            if op.quantiles:
                name = spec.column_name
                facts[i]["quantiles"] = [found[name][wanted[name].index(p)] for p in op.quantiles(spec.params)]
    for i, (op, spec) in enumerate(batch):
        if op.learn:
            facts[i].update(op.learn(df, spec.column_name, spec.params))
        if op.verify:
            op.verify(spec.column_name, spec.params, facts[i])
    return facts


def _reads(op: Operation, df: DataFrame, spec: OperationSpec) -> set[str]:
    if op.whole_table:
        return set(df.columns)
    return set(op.reads(df, spec.column_name, spec.params)) if op.reads else {spec.column_name}


#: Seconds to wait for what an action has observed; it is there when the action ends, unless Spark left a step out.
_OBSERVED_WITHIN = 30.0
ACCOUNT_SCHEMA = "step int, " + METRICS_SCHEMA + ", failed_count long, skewness_before double, skewness_after double"


@dataclass
class _Step:
    operation: Operation
    spec: OperationSpec
    facts: Facts
    before: Observation
    after: Observation


class WatchedChain:
    """The steps of a chain with counters in between, so that running it once also gives their accounts.

    ``dataframe`` is the result with the counters.  After one action over all its rows
    :meth:`accounts` holds a line per step; nothing is read again for it.
    """

    def __init__(self, df: DataFrame) -> None:
        self.dataframe = df
        self.result: ChainResult | None = None
        self._steps: list[_Step] = []

    def add(self, op: Operation, spec: OperationSpec, facts: Facts) -> None:
        name, params, df = spec.column_name, spec.params, self.dataframe
        seen = {"rows": F.count(F.lit(1))} | (op.before(df, name, params) if op.before else {})
        if op.measure is None:
            seen["affected_row_count"] = affected_rows(op, df, name, params, facts)
        before, after = Observation(), Observation()
        rewritten = op.rewrite(df.observe(before, *[c.alias(k) for k, c in seen.items()]), name, params, facts)
        left = {"rows": F.count(F.lit(1))} | (op.after(rewritten, name, params) if op.after else {})
        self.dataframe = rewritten.observe(after, *[c.alias(k) for k, c in left.items()])
        self._steps.append(_Step(op, spec, facts, before, after))

    @property
    def rows(self) -> int | None:
        """Rows of the result as observed."""
        found = _observed([s.after for s in self._steps[-1:]])
        return found[0]["rows"] if found and found[0] else None

    def accounts(self) -> list[tuple]:
        """Lines of ``ACCOUNT_SCHEMA``; a step that Spark did not run as a step of its own is counted by a scan."""
        seen = _observed([o for s in self._steps for o in (s.before, s.after)])
        lines = []
        for n, step in enumerate(self._steps):
            before, after = seen[2 * n], seen[2 * n + 1]
            name = step.spec.column_name
            if before is None or after is None:
                counted = self.result.outcomes[n].metrics.first()
                lines.append((n + 1, *counted, None, None, None))
                continue
            affected = before["rows"] - after["rows"] if step.operation.measure else before["affected_row_count"]
            changed = step.operation.columns_changed
            columns = changed(self.result.outcomes[n].before, name, step.facts) if changed else 1
            lines.append(
                (n + 1, step.spec.operation_key, name, affected, columns, before.get("failed_count"),
                 before.get("skewness_before"), after.get("skewness_after"))
            )
        return lines


def _observed(observations: Sequence[Observation]) -> list[dict | None]:
    """What was observed; None where nothing was within the time."""
    found: list[dict | None] = [None] * len(observations)

    def wait(n: int) -> None:
        found[n] = observations[n].get or None

    waiting = [threading.Thread(target=wait, args=(n,), daemon=True) for n in range(len(observations))]
    for thread in waiting:
        thread.start()
    until = time.monotonic() + _OBSERVED_WITHIN
    for thread in waiting:
        thread.join(max(0.0, until - time.monotonic()))
    return found


def watch_chain(df: DataFrame, specs: Sequence[OperationSpec], catalog: Catalog | None = None) -> WatchedChain:
    """:func:`run_chain` with counters between the steps."""
    watch = WatchedChain(df)
    watch.result = run_chain(df, specs, catalog, watch)
    return watch


def run_chain(
    df: DataFrame, specs: Sequence[OperationSpec], catalog: Catalog | None = None, watch: WatchedChain | None = None
) -> ChainResult:
    """Apply the steps in order; the result is one lazy plan.

    Consecutive steps that look at columns no earlier step of the batch has
    changed learn their statistics together, in one scan.
    """
    catalog = catalog or default_catalog()
    steps = [(catalog.get(s.operation_key), s) for s in specs]
    current, outcomes, at = df, [], 0
    while at < len(steps):
        batch, changed = [], set()
        while at < len(steps):
            op, spec = steps[at]
            blocked = batch and (
                spec.column_name not in [None, *current.columns] or _reads(op, current, spec) & changed
            )
            if blocked:
                break
            op.check(current, spec)
            batch.append((op, spec))
            at += 1
            changed |= {spec.column_name}
            if op.drops_rows or op.whole_table or op.reads:
                break
        for (op, spec), facts in zip(batch, _learn(current, batch)):
            before = current
            current = op.rewrite(before, spec.column_name, spec.params, facts)
            outcomes.append(
                Outcome(
                    spec,
                    current,
                    lambda op=op, spec=spec, before=before, facts=facts: metrics_of(op, spec, before, facts),
                    before,
                )
            )
            if watch is not None:
                watch.add(op, spec, facts)
    return ChainResult(current, outcomes)


def apply_operation(df: DataFrame, key: str, column: str | None = None, **params) -> DataFrame:
    """One operation on one column."""
    return run_chain(df, [OperationSpec(key, column, params)]).dataframe


@dataclass
class ChainPreview:
    """``steps`` has a line per step, ``accounts`` also failed conversions and skewness before and after."""

    steps: DataFrame
    before: DataFrame
    after: DataFrame
    sample_before: DataFrame
    sample_after: DataFrame
    accounts: DataFrame


def preview_chain(
    df: DataFrame, specs: Sequence[OperationSpec], catalog: Catalog | None = None, rows: int = 10
) -> ChainPreview:
    """What a chain would do: step accounts, overview before and after, sample rows.  Nothing is saved.

    The chain runs once for the accounts of all its steps.
    """
    watch = watch_chain(nan_to_null(df), specs, catalog)
    result = watch.result
    watch.dataframe.write.format("noop").mode("overwrite").save()
    accounts = df.sparkSession.createDataFrame(watch.accounts(), ACCOUNT_SCHEMA)
    return ChainPreview(
        accounts.drop("failed_count", "skewness_before", "skewness_after"),
        build_profile(df).overview,
        build_profile(result.dataframe).overview,
        df.limit(rows),
        result.dataframe.limit(rows),
        accounts,
    )

