"""Insights, recommendations and summary of a report: rules over the profile's small tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from sievework.operators import aggregates
from sievework.plans import charts
from sievework.plans.profile import Profile

# The thresholds of the rules.
CRITICAL_MISSING = 20.0
NOTABLE_MISSING = 5.0
NOTABLE_DUPLICATES = 1.0
HIGH_SKEW = 1.0
HIGH_OUTLIERS = 5.0
_NAMED = 5
_WORST = 3


def _names(condition: Column, rank: Column, limit: int, text: Column | None = None) -> Column:
    """Up to ``limit`` column names (or texts) in order of ``rank``, joined; NULL if there are none."""
    label = F.col("column_name") if text is None else text
    # One entry per table column at most.
    found = F.array_sort(
        F.collect_list(F.when(condition, F.struct(rank.alias("r"), F.col("ordinal").alias("o"), label.alias("t"))))
    )
    names = F.transform(F.slice(found, 1, limit), lambda s: s["t"])
    return F.when(F.size(found) > 0, F.array_join(names, ", "))


def _facts(profile: Profile, versions: DataFrame | None) -> DataFrame:
    """One row with everything the rules need."""
    share = lambda c: F.format_string("%s (%.1f%%)", "column_name", c)
    place, many = F.col("ordinal"), F.col("outlier_percentage") >= HIGH_OUTLIERS
    names = profile.statistics.agg(
        _names(
            F.col("missing_percentage") > 0, -F.col("missing_percentage"), _WORST, share("missing_percentage")
        ).alias("worst_missing"),
        _names(F.abs("skewness") >= HIGH_SKEW, place, _NAMED).alias("skewed"),
        _names(many, -F.col("outlier_percentage"), _WORST, share("outlier_percentage")).alias("worst_outliers"),
        _names(many, place, _NAMED).alias("outlier_columns"),
        _names(F.col("is_constant"), place, _NAMED).alias("constant"),
        _names(F.col("is_high_cardinality"), place, _NAMED).alias("wide"),
    )
    applied, steps = 0, 0
    if versions is not None:
        applied, steps = versions.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("operations")), F.lit(0))).first()
    overview = profile.overview.first().asDict()
    cells = max(1, overview["row_count"] * overview["column_count"])
    return names.select(
        *[F.lit(v).cast("long").alias(k) for k, v in overview.items()],
        F.lit(overview["total_missing_values"] / cells * 100).alias("missing_share"),
        F.lit(overview["total_duplicate_rows"] / max(1, overview["row_count"]) * 100).alias("duplicate_share"),
        "*",
        F.lit(applied).cast("long").alias("versions"),
        F.lit(steps).cast("long").alias("steps"),
    )


def _rules(facts: DataFrame, rules: list[tuple[Column, str, Column, Column]], level: str) -> DataFrame:
    """rank, title, level, detail of the rules whose condition holds."""
    cards = [
        F.when(
            condition,
            F.struct(
                F.lit(i + 1).alias("rank"), F.lit(title).alias("title"), grade.alias(level), detail.alias("detail")
            ),
        )
        for i, (condition, title, grade, detail) in enumerate(rules)
    ]
    kept = F.filter(F.array(*cards), lambda c: c.isNotNull())
    return facts.select(F.inline(kept))


def insights(profile: Profile, versions: DataFrame | None = None) -> DataFrame:
    """rank, title, severity, detail."""
    info, warning, critical = F.lit("info"), F.lit("warning"), F.lit("critical")
    missing, repeated = F.col("total_missing_values"), F.col("total_duplicate_rows")
    rounded = F.round("missing_share", 2)
    say = F.format_string
    rules = [
        (
            F.lit(True),
            "Dataset scale",
            info,
            say(
                "%s rows and %s columns, %d numeric and %d categorical",
                F.format_number("row_count", 0),
                F.format_number("column_count", 0),
                "numeric_column_count",
                "categorical_column_count",
            ),
        ),
        (missing == 0, "No missing values", info, F.lit("every cell is filled")),
        (
            missing > 0,
            "Missing data present",
            F.when(rounded >= CRITICAL_MISSING, critical).when(rounded >= NOTABLE_MISSING, warning).otherwise(info),
            say("%s cells (%.2f%%), most in %s", F.format_number(missing, 0), "missing_share", "worst_missing"),
        ),
        (
            repeated > 0,
            "Duplicate rows detected",
            F.when(F.round("duplicate_share", 2) >= NOTABLE_DUPLICATES, warning).otherwise(info),
            say("%s rows (%.2f%%)", F.format_number(repeated, 0), "duplicate_share"),
        ),
        (F.col("skewed").isNotNull(), "Skewed distributions", info, F.col("skewed")),
        (F.col("worst_outliers").isNotNull(), "Notable outliers", warning, F.col("worst_outliers")),
        (F.col("constant").isNotNull(), "Constant columns", warning, F.col("constant")),
        (F.col("wide").isNotNull(), "High-cardinality columns", info, F.col("wide")),
        (
            F.col("versions") > 0,
            "Cleaning applied",
            info,
            say("%d version(s), %d operation(s)", "versions", "steps"),
        ),
    ]
    return _rules(_facts(profile, versions), rules, "severity")


def recommendations(profile: Profile) -> DataFrame:
    """rank, title, priority, detail."""
    high, medium, low = F.lit("high"), F.lit("medium"), F.lit("low")
    rules = [
        (
            F.col("total_missing_values") > 0,
            "Address missing values",
            F.when(F.col("missing_share") >= CRITICAL_MISSING, high).otherwise(medium),
            F.col("worst_missing"),
        ),
        (
            F.col("total_duplicate_rows") > 0,
            "Remove duplicate rows",
            medium,
            F.format_string("%s rows", F.format_number("total_duplicate_rows", 0)),
        ),
        (F.col("constant").isNotNull(), "Drop constant columns", low, F.col("constant")),
        (F.col("skewed").isNotNull(), "Transform skewed features", medium, F.col("skewed")),
        (F.col("outlier_columns").isNotNull(), "Review outliers", medium, F.col("outlier_columns")),
        (F.col("wide").isNotNull(), "Encode high-cardinality columns carefully", low, F.col("wide")),
        (
            F.col("numeric_column_count") >= 2,
            "Explore correlations",
            low,
            F.format_string("%d numeric columns", "numeric_column_count"),
        ),
    ]
    anything = F.lit(False)
    for condition, *_ in rules:
        anything = anything | condition
    rules.append((~anything, "Dataset is analysis-ready", low, F.lit("no rule found anything to do")))
    return _rules(_facts(profile, None), rules, "priority")


def report_summary(profile: Profile, versions: DataFrame | None = None) -> DataFrame:
    """One row: the overview, the share of missing cells, and the version count."""
    return _facts(profile, versions).select(
        "row_count",
        "column_count",
        "numeric_column_count",
        "categorical_column_count",
        "total_missing_values",
        F.round("missing_share", 2).alias("missing_percentage"),
        "total_duplicate_rows",
        F.col("versions").alias("version_count"),
    )


def report_tables(profile: Profile, versions: DataFrame | None = None) -> Mapping[str, DataFrame]:
    """Every table of a full export, by title; the data itself is written whole."""
    df = profile.df
    tables = {
        "KPIs": charts.default_kpis(profile),
        "Dataset": df,
        "Numeric statistics": profile.numeric,
        "Categorical statistics": profile.categorical,
        "Overview": report_summary(profile, versions),
        "Column profiles": profile.columns,
        "Data quality": profile.quality,
        "Outliers": profile.outliers,
        "Insights": insights(profile, versions),
        "Recommendations": recommendations(profile),
        "Numeric column aggregates": aggregates.numeric_totals(df),
        "Category counts": aggregates.category_counts(df),
    }
    if profile.categorical_names and profile.numeric_names:
        category, measure = profile.categorical_names[0], profile.numeric_names[0]
        tables[f"{measure} by {category}"] = aggregates.measure_by_category(df, category, measure)
        for title, kind, series in (
            ("Bar chart", "bar", charts.bar(df, category)),
            ("Pie chart", "pie", charts.pie(df, category)),
            ("Histogram", "histogram", charts.histogram(df, measure)),
            ("Box plot", "box", charts.box(df, measure)),
        ):
            tables[title] = charts.chart_to_table(kind, series)
    if len(profile.numeric_names) >= 2:
        x, y = profile.numeric_names[:2]
        tables["Scatter plot"] = charts.chart_to_table("scatter", charts.scatter(df, x, y))
        tables["Correlation heatmap"] = charts.chart_to_table("heatmap", charts.heatmap(df, profile.numeric_names))
    return tables
