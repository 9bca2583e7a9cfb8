"""The tables behind charts and key figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from sievework.errors import AggregationError
from sievework.functions.columns import as_double, local_table, quoted, require_columns, require_numeric
from sievework.functions.frequencies import top_values
from sievework.functions.ordering import Order, sort_columns
from sievework.functions.quantiles import exact_quantiles
from sievework.operators.aggregates import Aggregation, aggregate, group_by
from sievework.operators.correlation import correlation
from sievework.operators.outliers import bounds_from_quartiles, is_outlier
from sievework.plans.profile import Profile
from sievework.session import materialize


def histogram(df: DataFrame, column: str) -> DataFrame:
    """bucket, lower, upper, count.  One bucket per 20 values, but 10 to 40 of them."""
    require_numeric(df, column)
    x = as_double(df, column)
    row = df.agg(F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    schema = "bucket int, lower double, upper double, count long"
    if not row["n"]:
        return df.sparkSession.createDataFrame([], schema)
    buckets = min(40, max(10, row["n"] // 20))
    low, high = (row["lo"], row["hi"]) if row["lo"] < row["hi"] else (row["lo"] - 0.5, row["hi"] + 0.5)
    width = (high - low) / buckets
    number = F.least(F.lit(buckets - 1), F.floor((x - low) / width).cast("int"))
    counted = df.filter(x.isNotNull()).groupBy(number.alias("bucket")).agg(F.count(F.lit(1)).alias("count"))
    frame = local_table(
        df.sparkSession,
        [(i, low + i * width, low + (i + 1) * width) for i in range(buckets)],
        "bucket int, lower double, upper double",
    )
    # Both sides have at most 40 rows.
    return frame.join(counted, "bucket", "left").select(
        "bucket", "lower", "upper", F.coalesce("count", F.lit(0)).alias("count")
    )


def scatter(df: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y) of every row."""
    require_numeric(df, x)
    require_numeric(df, y)
    return df.select(quoted(x).alias("x"), quoted(y).alias("y"))


def line(df: DataFrame, x: str, y: str, order_by: Sequence[str | Order] | str | None = None) -> DataFrame:
    """(x, y) of every row along x, or along ``order_by``."""
    require_columns(df, [x])
    require_numeric(df, y)
    return df.orderBy(*sort_columns(order_by or x)).select(quoted(x).alias("x"), quoted(y).alias("y"))


def bar(df: DataFrame, category: str, value: str | None = None, limit: int = 10) -> DataFrame:
    """label, value: counts of the most frequent categories, or the largest sums (missing kept)."""
    if value is None:
        return top_values(df, category, limit).select(
            F.col("value").cast("string").alias("label"), F.col("count").alias("value")
        )
    rows = group_by(df, [category], [Aggregation("sum", value, "__total")], limit).rows
    return rows.select(quoted(category).cast("string").alias("label"), F.col("__total").alias("value"))


def pie(df: DataFrame, category: str, limit: int = 8) -> DataFrame:
    """label, value: the largest shares, missing cells as their own slice."""
    named = df.select(F.coalesce(quoted(category).cast("string"), F.lit("Missing")).alias("label"))
    return top_values(named, "label", limit).select(
        F.col("value").alias("label"), F.col("count").alias("value")
    )


def box(df: DataFrame, column: str) -> DataFrame:
    """One row: minimum, quartiles, maximum, whisker ends, number of outliers."""
    require_numeric(df, column)
    (q1, median, q3) = exact_quantiles(df, {column: [0.25, 0.5, 0.75]})[column]
    bounds, x = bounds_from_quartiles(q1, q3), as_double(df, column)
    inside = F.when(~is_outlier(x, bounds), x)
    return df.agg(
        F.min(x).alias("minimum"),
        F.lit(q1).cast("double").alias("q1"),
        F.lit(median).cast("double").alias("median"),
        F.lit(q3).cast("double").alias("q3"),
        F.max(x).alias("maximum"),
        F.min(inside).alias("lower_whisker"),
        F.max(inside).alias("upper_whisker"),
        F.count_if(is_outlier(x, bounds)).alias("outlier_count"),
    )


def heatmap(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_x, column_y, value) of the correlation matrix, to four digits."""
    return correlation(df, columns).select(
        "column_x", "column_y", F.round("correlation", 4).alias("value")
    )


# How a chart's columns are called in an exported table (fixed values).
_TABLE_COLUMNS = {
    "bar": {"label": "Category", "value": "Value"},
    "line": {"x": "Axis", "y": "Value"},
    "pie": {"label": "Label", "value": "Value"},
    "scatter": {"x": "X", "y": "Y"},
    "histogram": {"bucket": "Bucket", "lower": "From", "upper": "To", "count": "Value"},
    "box": {},
}


def chart_to_table(chart_type: str, series: DataFrame) -> DataFrame:
    """A chart's series under the column names of an export; heat maps become a matrix."""
    if chart_type == "heatmap":
        series = materialize(series, "heatmap")  # a row per cell, read for the names and for the matrix
        names = sorted(r[0] for r in series.select("column_x").distinct().collect())
        return (
            series.groupBy(F.col("column_x").alias("Variable"))
            .pivot("column_y", names)
            .agg(F.first("value"))
        )
    renames = _TABLE_COLUMNS[chart_type]
    return series.select([quoted(c).alias(renames.get(c, c)) for c in series.columns])


def default_kpis(profile: Profile) -> DataFrame:
    """title, value: the six standing key figures, with thousands separators."""
    # Titles of the key figures and the overview figure behind each.
    figures = (
        ("Total Records", "row_count"),
        ("Total Columns", "column_count"),
        ("Missing Values", "total_missing_values"),
        ("Duplicate Rows", "total_duplicate_rows"),
        ("Numeric Columns", "numeric_column_count"),
        ("Categorical Columns", "categorical_column_count"),
    )
    cards = [F.struct(F.lit(t).alias("title"), F.format_number(F.col(c), 0).alias("value")) for t, c in figures]
    return profile.overview.select(F.inline(F.array(*cards)))


def requested_kpis(df: DataFrame, specs: Sequence[Aggregation]) -> DataFrame:
    """title, value of the asked-for aggregations; ones that do not fit the column are skipped."""
    usable = []
    for spec in specs:
        try:
            aggregate(df.limit(0), [spec])
            usable.append(spec)
        except AggregationError:
            continue
    schema = "title string, value string"
    if not usable:
        return df.sparkSession.createDataFrame([], schema)
    row = aggregate(df, [Aggregation(s.operation, s.column, f"k{i}") for i, s in enumerate(usable)])
    cards = []
    for i, s in enumerate(usable):
        title = "Count Rows" if s.column is None else s.name(i).replace("_", " ").title()
        cards.append(F.struct(F.lit(title).alias("title"), F.col(f"k{i}").cast("string").alias("value")))
    return row.select(F.inline(F.array(*cards)))
