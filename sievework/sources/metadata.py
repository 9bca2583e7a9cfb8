"""What tables there are and what they look like."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sievework.functions.columns import is_numeric, is_text


def list_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Table names in alphabetical order."""
    names = sorted({t.name for t in spark.catalog.listTables(database)})
    return spark.createDataFrame([(n,) for n in names], "table_name string")


# Query for a database's own listing, to be used with ``scan_jdbc_query``.
JDBC_TABLES_QUERY = "SELECT TABLE_NAME FROM INFORMATION_SCHEMA.TABLES WHERE TABLE_TYPE = 'BASE TABLE'"


def table_columns(df: DataFrame) -> DataFrame:
    """One row per column: position, type, nullability, text length, precision, scale."""
    rows = []
    for i, f in enumerate(df.schema.fields):
        length = getattr(f.dataType, "length", None)
        declared = f.metadata.get("__CHAR_VARCHAR_TYPE_STRING", "")
        if is_text(f.dataType) and length is None and "(" in declared:
            length = int(declared.split("(")[1].rstrip(")"))
        precision = scale = None
        if isinstance(f.dataType, T.DecimalType):
            precision, scale = f.dataType.precision, f.dataType.scale
        elif is_numeric(f.dataType):
            # Decimal digits of whole types, binary digits of fractions.
            precision = {"byte": 3, "short": 5, "integer": 10, "long": 19, "float": 24, "double": 53}[
                f.dataType.typeName()
            ]
            scale = None if f.dataType.typeName() in ("float", "double") else 0
        rows.append((f.name, f.dataType.simpleString(), f.nullable, i + 1, length, precision, scale))
    return df.sparkSession.createDataFrame(
        rows,
        "column_name string, data_type string, is_nullable boolean, ordinal_position int, "
        "character_maximum_length int, numeric_precision int, numeric_scale int",
    )


def table_row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))
