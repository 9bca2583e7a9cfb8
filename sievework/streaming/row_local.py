"""Row-local work on a stream.

Filters and those cleaning operations that look at one row at a time need no
state, window or watermark, so they run unchanged on a streaming DataFrame.
Anything that learns from the whole table is refused.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from sievework.errors import OperationError
from sievework.operators.cleaning.base import Catalog, OperationSpec
from sievework.operators.filters import Condition, keep_rows
from sievework.plans.cleaning import default_catalog


def clean_stream(
    stream: DataFrame,
    specs: Sequence[OperationSpec],
    conditions: Sequence[Condition] = (),
    catalog: Catalog | None = None,
) -> DataFrame:
    """Filter a stream, then apply row-local operations in order."""
    catalog = catalog or default_catalog()
    current = keep_rows(stream, conditions)
    for spec in specs:
        operation = catalog.get(spec.operation_key)
        if not operation.row_local:
            raise OperationError(f"'{operation.key}' needs the whole table and cannot run on a stream.")
        operation.check(current, spec)
        current = operation.rewrite(current, spec.column_name, spec.params, {})
    return current
