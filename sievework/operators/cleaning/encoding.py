"""Categories to numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sievework.errors import OperationError
from sievework.functions.columns import as_double, put, quoted
from sievework.functions.frequencies import LOOKUP_ROWS, attach
from sievework.functions.ordering import with_position
from sievework.operators.cleaning.base import Operation
from sievework.session import materialize

MAX_ONE_HOT = 2_000


def _bound(params) -> int:
    return int(params.get("lookup_rows", LOOKUP_ROWS))


def _values(df: DataFrame, name: str) -> DataFrame:
    return df.filter(quoted(name).isNotNull()).groupBy(quoted(name).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def _label(df: DataFrame, name: str, params, facts) -> DataFrame:
    """0..n-1 in text order; the numbering is range-wise, so any number of categories works."""
    # Written once: numbering reads the categories several times, the table only once.
    texts = materialize(_values(df, name).withColumn("__text", F.col("key").cast("string")), "categories")
    codes = with_position(texts, "__text", "value").select("key", "value", "n")
    return attach(df, name, codes, name, _bound(params))


def _one_hot_values(df: DataFrame, name: str, params) -> dict:
    most = int(params.get("max_categories", MAX_ONE_HOT))
    rows = _values(df, name).select("key").limit(most + 1).collect()
    if len(rows) > most:
        raise OperationError(f"'{name}' has more than {most} categories; one column each is not workable.")
    return {"values": sorted(r["key"] for r in rows)}


def _one_hot(df: DataFrame, name: str, params, facts) -> DataFrame:
    flags = [
        F.coalesce(quoted(name) == F.lit(v), F.lit(False)).alias(f"{name}_{v}") for v in facts["values"]
    ]
    return df.select(*[quoted(c) for c in df.columns if c != name], *flags)


def _ordinal(df: DataFrame, name: str, params, facts) -> DataFrame:
    order = params.get("order")
    if not order:
        raise OperationError("Ordinal encoding needs params.order, the categories from lowest to highest.")
    pairs = [v for rank, category in enumerate(order) for v in (F.lit(category), F.lit(rank).cast("long"))]
    return put(df, name, F.try_element_at(F.create_map(*pairs), quoted(name)))


def _target(df: DataFrame, name: str, params, facts) -> DataFrame:
    target = params.get("target_column")
    if not target or target not in df.columns:
        raise OperationError("Target encoding needs params.target_column, a numeric column.")
    means = (
        df.filter(quoted(name).isNotNull())
        .groupBy(quoted(name).alias("key"))
        .agg(F.avg(as_double(df, target)).alias("value"), F.count(F.lit(1)).alias("n"))
    )
    return attach(df, name, means, name, _bound(params))


def _frequency(df: DataFrame, name: str, params, facts) -> DataFrame:
    shares = _values(df, name).withColumn("value", F.col("n") / F.lit(max(1, facts["filled"])))
    return attach(df, name, shares.select("key", "value", "n"), name, _bound(params))


OPERATIONS = [
    Operation("encoding.label", "Label Encoding", _label, learn=lambda df, c, p: {}),
    Operation(
        "encoding.one_hot",
        "One-Hot Encoding",
        _one_hot,
        learn=_one_hot_values,
        columns_changed=lambda df, c, f: len(f["values"]),
    ),
    Operation("encoding.ordinal", "Ordinal Encoding", _ordinal),
    Operation(
        "encoding.target",
        "Target Encoding",
        _target,
        learn=lambda df, c, p: {},
        reads=lambda df, c, p: [c, *([p["target_column"]] if "target_column" in p else [])],
    ),
    Operation(
        "encoding.frequency",
        "Frequency Encoding",
        _frequency,
        learn=lambda df, c, p: {"filled": df.agg(F.count(quoted(c))).first()[0]},
    ),
]
