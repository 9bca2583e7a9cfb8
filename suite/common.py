"""Tables, gaps and rounding shared by the checked queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sievework.session import ship_package
from sievework.sources.readers import scan_parquet

Query = Callable[[SparkSession, str], DataFrame]


class Suite:
    """Queries by name, most with SQL for DuckDB."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, query: Query, sql: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"'{name}' is there already")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return query(ship_package(spark), sf_dir)

        self.queries[name] = run
        if sql is not None:
            self.sql[name] = sql


def raw_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as it is stored, so that filters reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return scan_parquet(spark, f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        raw_table(spark, sf_dir, name).createOrReplaceTempView(name)


# The given tables hold no missing cells, so gaps are made by the same rule on both sides.
GAP_EVENTS = (
    "(select event_id, ts, user_id, event_type, "
    "case when event_id % 7 = 0 then null else value end as value, props from events)"
)


def gap_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value")))


# Several kinds of gaps, for profile rules.
MIXED_GAPS = (
    "(select event_id, case when event_id % 40 = 0 then null else user_id end as user_id, "
    "case when event_id % 50 = 0 then null else event_type end as event_type, "
    "case when event_id % 7 = 0 then null else value end as value, "
    "case when event_id % 4 = 0 then value end as rare_value, "
    "case when event_id % 40 = 1 then null else value end as mostly_value, "
    "case when event_id % 3 = 0 then null else props end as props, "
    "cast(user_id as varchar) as user_text, "
    "case when event_id >= 0 then 'x' end as one_value from events)"
)


def mixed_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    return e.select(
        "event_id",
        F.when(i % 40 != 0, F.col("user_id")).alias("user_id"),
        F.when(i % 50 != 0, F.col("event_type")).alias("event_type"),
        F.when(i % 7 != 0, F.col("value")).alias("value"),
        F.when(i % 4 == 0, F.col("value")).alias("rare_value"),
        F.when(i % 40 != 1, F.col("value")).alias("mostly_value"),
        F.when(i % 3 != 0, F.col("props")).alias("props"),
        F.col("user_id").cast("string").alias("user_text"),
        F.when(i >= 0, F.lit("x")).alias("one_value"),
    )


def rounded(df: DataFrame, digits: int = 4, **by_column: int) -> DataFrame:
    """Fractions to a fixed number of digits, so that both engines print the same."""
    return df.select(
        [
            F.round(F.col(f.name), by_column.get(f.name, digits)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )
