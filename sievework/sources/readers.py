"""Reading tables: delimited files, Parquet, JDBC tables and queries."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from sievework.errors import SourceError
from sievework.functions.columns import nan_to_null, quoted
from sievework.functions.parsing import INTEGER_PATTERN, MISSING_TOKENS, parse_number
from sievework.operators.filters import Condition, keep_rows
from sievework.sources.records import column_names, may_break, records

# Spellings read as booleans when a whole column consists of them.
_BOOLEAN_WORDS = ("True", "TRUE", "true", "False", "FALSE", "false")


@dataclass(frozen=True)
class SourceSpec:
    """Where a table comes from: ``kind`` picks the reader."""

    kind: str
    path: str | None = None
    table: str | None = None
    url: str | None = None
    options: Mapping[str, str] = field(default_factory=dict)
    schema: T.StructType | str | None = None
    tables: tuple[str, ...] | None = None


def scan_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, **options: str
) -> DataFrame:
    """A delimited file with header.

    Missing tokens become NULL before types are decided, so ``NA`` in a column
    of numbers does not turn it into text.  Types are decided from all rows in
    one scan; give ``schema`` to skip that scan.

    Quoted cells may hold line breaks, and files are read in byte ranges all the
    same: if some record runs over lines, records are cut out by
    :mod:`sievework.sources.records` and written once.  ``multiLine`` "true" or
    "false" leaves that to Spark's own reader, as do other escapes, encodings,
    comments and separators of several characters, and text with stray quotes.
    """
    text = _text_cells(spark, path, options)
    if schema is not None:
        # One reader setting covers one token only; read text, null the set, then cast.
        wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        cells = [_cell(quoted(f.name)).try_cast(f.dataType).alias(f.name) for f in wanted.fields]
        return nan_to_null(text.select(cells))
    text = text.select([_cell(quoted(c)).alias(c) for c in text.columns])
    return text.select([_typed(quoted(c), kind).alias(c) for c, kind in _kinds(text).items()])


#: Options that say nothing about where a record ends.
_CELL_OPTIONS = {"header", "sep", "delimiter", "quote", "escape", "nullvalue", "emptyvalue", "ignoreleadingwhitespace", "ignoretrailingwhitespace"}


def _text_cells(spark: SparkSession, path: str, options: Mapping[str, str]) -> DataFrame:
    """All cells as text."""
    settings = {"header": "true", "escape": '"', **options}
    given = {k.lower(): str(v) for k, v in settings.items()}
    sep, quote = given.get("sep", given.get("delimiter", ",")), given.get("quote", '"')
    plain = set(given) <= _CELL_OPTIONS and given["escape"] == quote and len(sep.encode()) == len(quote.encode()) == 1
    if not plain:
        return spark.read.options(**{"multiLine": "true", **settings}).csv(path)
    if not may_break(spark, path, sep, quote):
        return spark.read.options(**settings).csv(path)
    found = records(spark, path, sep, quote)
    whole = {"multiLine": "true", **settings}
    if found is None:
        return spark.read.options(**whole).csv(path)
    header = given["header"].lower() == "true"
    names = column_names(found, sep, quote, header)
    if header:
        found = found.filter(~F.col("first"))
    spec = ", ".join(f"c{i} string" for i in range(len(names)))
    cells = F.from_csv("value", spec, {k: str(v) for k, v in whole.items() if k.lower() != "header"})
    parsed = found.filter(F.trim("value") != "").select(cells.alias("cells"))
    return parsed.select([F.col(f"cells.c{i}").alias(name) for i, name in enumerate(names)])


def _cell(column: Column) -> Column:
    return F.when(~column.isin(*MISSING_TOKENS), column)


def _kinds(text: DataFrame) -> dict[str, str]:
    """The narrowest type every filled cell of a column fits: one scan, one row."""
    checks = []
    for i, name in enumerate(text.columns):
        c = quoted(name)
        whole = c.rlike(INTEGER_PATTERN) & F.trim(c).try_cast("bigint").isNotNull()
        checks += [
            F.count(c).alias(f"n{i}"),
            F.count_if(whole).alias(f"whole{i}"),
            F.count_if(parse_number(c).isNotNull()).alias(f"number{i}"),
            F.count_if(c.isin(*_BOOLEAN_WORDS)).alias(f"flag{i}"),
        ]
    row = text.agg(*checks).first()
    kinds = {}
    for i, name in enumerate(text.columns):
        filled = row[f"n{i}"]
        if filled == row[f"whole{i}"] and filled:
            kinds[name] = "bigint"
        elif filled == row[f"number{i}"]:  # also an all-missing column
            kinds[name] = "double"
        elif filled == row[f"flag{i}"]:
            kinds[name] = "boolean"
        else:
            kinds[name] = "string"
    return kinds


def _typed(column: Column, kind: str) -> Column:
    if kind == "double":
        return parse_number(column)
    if kind == "string":
        return column
    return F.trim(column).try_cast(kind)


def scan_parquet(
    spark: SparkSession, path: str, conditions: Sequence[Condition] = (), **options: str
) -> DataFrame:
    """A Parquet table; floating NaN counts as missing.

    Pass known ``conditions`` here: they are applied to the raw columns, so
    Spark pushes them into the scan and skips row groups.
    """
    return nan_to_null(keep_rows(spark.read.options(**options).parquet(path), conditions))


def jdbc_options(
    url: str,
    table: str | None = None,
    query: str | None = None,
    partition: tuple[str, int | str, int | str, int] | None = None,
    **options: str,
) -> dict[str, str]:
    """Reader options for a table or a query.

    ``partition`` = (column, lower, upper, number) reads a table in parallel;
    without it one task reads everything.
    """
    if not table and not query:
        raise SourceError("A table name is required for a database source.")
    settings = {"url": url, "fetchsize": "10000", **options}
    if query:
        settings["query"] = query
    else:
        settings["dbtable"] = table
        if partition:
            column, lower, upper, number = partition
            settings |= {
                "partitionColumn": column,
                "lowerBound": str(lower),
                "upperBound": str(upper),
                "numPartitions": str(number),
            }
    return settings


def scan_jdbc_table(spark: SparkSession, url: str, table: str, partition=None, **options: str) -> DataFrame:
    settings = jdbc_options(url, table=table, partition=partition, **options)
    return nan_to_null(spark.read.format("jdbc").options(**settings).load())


def scan_jdbc_query(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    settings = jdbc_options(url, query=query, **options)
    return nan_to_null(spark.read.format("jdbc").options(**settings).load())


def _read_jdbc(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    if not spec.table:
        raise SourceError("A table name is required for a database source.")
    if spec.tables is not None and spec.table not in spec.tables:
        raise SourceError(f"Table '{spec.table}' is not in this source.")
    return scan_jdbc_table(spark, spec.url or "", spec.table, **spec.options)


def _read_catalog(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    if not spec.table:
        raise SourceError("A table name is required for a catalog source.")
    if not spark.catalog.tableExists(spec.table):
        raise SourceError(f"Table '{spec.table}' does not exist.")
    return nan_to_null(spark.table(spec.table))


# Readers by source kind; register another one to add a source.
READERS: dict[str, Callable[[SparkSession, SourceSpec], DataFrame]] = {
    "csv": lambda spark, spec: scan_csv(spark, spec.path, spec.schema, **spec.options),
    "parquet": lambda spark, spec: scan_parquet(spark, spec.path, **spec.options),
    "jdbc": _read_jdbc,
    "table": _read_catalog,
}


def load(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    """Read a source with the reader of its kind."""
    if spec.kind not in READERS:
        raise SourceError(f"No reader for sources of kind '{spec.kind}'.")
    if spec.kind in ("csv", "parquet") and not spec.path:
        raise SourceError("A file source needs a path.")
    return READERS[spec.kind](spark, spec)
