"""Writing results: query results as new sources, and report tables as folders."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sievework.errors import ExportError
from sievework.functions.columns import quoted
from sievework.plans.sql import read_only_query
from sievework.sources.readers import SourceSpec


def _flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, which delimited files can hold."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(
        [
            F.to_json(quoted(f.name)).alias(f.name) if isinstance(f.dataType, nested) else quoted(f.name)
            for f in df.schema.fields
        ]
    )


# Writers by format name; register another one to add a format.
WRITERS: dict[str, Callable[[DataFrame, str], None]] = {
    "parquet": lambda df, path: df.write.mode("errorifexists").parquet(path),
    "csv": lambda df, path: _flat(df).write.mode("errorifexists").option("header", "true").option(
        "escape", '"'
    ).csv(path),
}


def folder_name(title: str) -> str:
    """A title as a folder name: words joined by dashes, in lower case."""
    return re.sub(r"[^\w\-]+", "-", title.strip()).strip("-").lower() or "table"


def export_tables(tables: Mapping[str, DataFrame], folder: str, format_name: str = "parquet") -> dict[str, str]:
    """One folder per table, whole tables; returns title -> path."""
    if format_name not in WRITERS:
        raise ExportError(f"No export format '{format_name}'; there are {', '.join(sorted(WRITERS))}.")
    paths: dict[str, str] = {}
    for title, table in tables.items():
        name, n = folder_name(title), 2
        while f"{folder}/{name}" in paths.values():
            name, n = f"{folder_name(title)}-{n}", n + 1
        WRITERS[format_name](table, f"{folder}/{name}")
        paths[title] = f"{folder}/{name}"
    return paths


def query_to_dataset(spark: SparkSession, sql: str, path: str) -> SourceSpec:
    """Save the result of a read-only query as a Parquet source."""
    read_only_query(spark, sql).write.mode("errorifexists").parquet(path)
    return SourceSpec("parquet", path=path)
