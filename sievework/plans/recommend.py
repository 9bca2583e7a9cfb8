"""Cleaning recommendations.

All but two kinds read only the profile's small tables.  Type and text
recommendations look at the cell texts once, in one aggregation for all text
columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sievework.functions.columns import quoted, text_columns, words
from sievework.functions.parsing import parse_number, parse_timestamp
from sievework.plans.profile import Profile

# The thresholds of the rules.
SPARSE_PERCENT = 60.0
MODERATE_PERCENT = 30.0
LOW_PERCENT = 5.0
SKEWED = 1.0
NEARLY_SYMMETRIC = 0.5
PARSE_SHARE = 0.95
CATEGORY_SHARE = 0.5
TEXT_WORDS = 3
TEXT_LENGTH = 30
RARE_OUTLIERS = 1.0
ONE_HOT_VALUES = 10

_OUT = ("category", "column_name", "operation_key", "alternatives", "reason")


def _keys(*names: str) -> Column:
    return F.array(*[F.lit(n) for n in names]).cast("array<string>")


def _others(chosen: Column, *keys: str) -> Column:
    return F.filter(_keys(*keys), lambda k: k != chosen)


def _result(table: DataFrame, category: str) -> DataFrame:
    return table.filter(F.col("operation_key").isNotNull()).select(F.lit(category).alias("category"), *_OUT[1:])


def _percent(column: str, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", F.col(column))


def missing_values(profile: Profile) -> DataFrame:
    share = F.col("missing_percentage")
    uneven = (F.coalesce("outlier_count", F.lit(0)) > 0) | (F.coalesce(F.abs("skewness"), F.lit(0.0)) >= SKEWED)
    number, low = F.col("is_numeric"), share <= LOW_PERCENT

    def rule(key: str, *alternatives: str) -> Column:
        full = [f"missing_values.{a}" for a in alternatives]
        return F.struct(F.lit(f"missing_values.{key}").alias("k"), _keys(*full).alias("a"))

    chosen = (
        F.when(share > SPARSE_PERCENT, rule("drop_columns", "drop_rows"))
        .when(number & low & uneven, rule("median", "mean", "knn", "interpolate"))
        .when(number & low, rule("mean", "median", "interpolate"))
        .when(number & (share <= MODERATE_PERCENT), rule("knn", "missforest", "median"))
        .when(number, rule("missforest", "knn", "drop_columns"))
        .when(low, rule("mode", "constant", "drop_rows"))
        .otherwise(rule("constant", "mode", "drop_columns"))
    )
    table = profile.statistics.filter(F.col("missing_count") > 0).withColumn("c", chosen)
    return _result(
        table.select(
            "column_name",
            F.col("c.k").alias("operation_key"),
            F.col("c.a").alias("alternatives"),
            F.concat(_percent("missing_percentage"), F.lit(" of the cells are missing")).alias("reason"),
        ),
        "missing_values",
    )


def duplicates(profile: Profile) -> DataFrame:
    n = F.col("total_duplicate_rows")
    return _result(
        profile.overview.select(
            F.lit(None).cast("string").alias("column_name"),
            F.when(n > 0, F.lit("duplicates.remove")).alias("operation_key"),
            _keys("duplicates.keep_first", "duplicates.keep_last", "duplicates.keep_unique").alias("alternatives"),
            F.format_string("%d of %d rows repeat another row", n, F.col("row_count")).alias("reason"),
        ),
        "duplicates",
    )


def _text_facts(profile: Profile) -> DataFrame:
    """One row per text column: how its filled cells parse, and how long they are."""
    df, names = profile.df, text_columns(profile.df)
    schema = (
        "column_name string, filled long, numbers long, fractions long, dates long, mean_words double, "
        "mean_length double, distinct_values long"
    )
    if not names:
        return df.sparkSession.createDataFrame([], schema)
    aggregates = []
    for i, name in enumerate(names):
        c = quoted(name)
        number = parse_number(c)
        aggregates += [
            F.count(c).alias(f"filled{i}"),
            F.count_if(number.isNotNull()).alias(f"numbers{i}"),
            F.count_if(number != F.floor(number)).alias(f"fractions{i}"),
            F.count_if(parse_timestamp(c).isNotNull()).alias(f"dates{i}"),
            F.avg(F.size(F.when(c.isNotNull(), words(c)))).alias(f"mean_words{i}"),
            F.avg(F.length(c)).alias(f"mean_length{i}"),
        ]
    row = df.agg(*aggregates).first()
    labels = ("filled", "numbers", "fractions", "dates", "mean_words", "mean_length")
    rows = [
        (name, *[row[f"{label}{i}"] for label in labels], profile._values[name]["distinct"])
        for i, name in enumerate(names)
        if row[f"filled{i}"]
    ]
    return df.sparkSession.createDataFrame(rows, schema)


def type_conversion(profile: Profile, facts: DataFrame | None = None) -> DataFrame:
    facts = _text_facts(profile) if facts is None else facts
    numbers, dates = F.col("numbers") / F.col("filled"), F.col("dates") / F.col("filled")
    number = numbers >= PARSE_SHARE
    key = (
        F.when(number & (F.col("fractions") == 0), F.lit("type_conversion.to_integer"))
        .when(number, F.lit("type_conversion.to_float"))
        .when(dates >= PARSE_SHARE, F.lit("type_conversion.to_datetime"))
        .when(F.col("distinct_values") / F.col("filled") <= CATEGORY_SHARE, F.lit("type_conversion.to_category"))
    )
    both = _keys("type_conversion.to_float", "type_conversion.to_integer")
    return _result(
        facts.select(
            "column_name",
            key.alias("operation_key"),
            F.when(number, both).otherwise(F.array().cast("array<string>")).alias("alternatives"),
            F.when(number, F.format_string("%.0f%% of the values are numbers", numbers * 100))
            .when(dates >= PARSE_SHARE, F.format_string("%.0f%% of the values are dates", dates * 100))
            .otherwise(F.format_string("only %d different values", F.col("distinct_values")))
            .alias("reason"),
        ),
        "type_conversion",
    )


def outliers(profile: Profile) -> DataFrame:
    key = (
        F.when(F.col("outlier_percentage") < RARE_OUTLIERS, F.lit("outliers.remove"))
        .when(F.abs("skewness") >= SKEWED, F.lit("outliers.log_transform"))
        .otherwise(F.lit("outliers.iqr_capping"))
    )
    table = profile.statistics.filter(F.col("outlier_count") > 0).withColumn("operation_key", key)
    known = ("remove", "iqr_capping", "winsorization", "zscore_filter", "log_transform")
    return _result(
        table.withColumn("alternatives", _others(F.col("operation_key"), *[f"outliers.{k}" for k in known]))
        .withColumn("reason", F.concat(_percent("outlier_percentage", 2), F.lit(" of the rows are outliers"))),
        "outliers",
    )


def encoding(profile: Profile) -> DataFrame:
    n = F.col("unique_count")
    key = (
        F.when(n == 2, F.lit("encoding.label"))
        .when((n > 2) & (n <= ONE_HOT_VALUES), F.lit("encoding.one_hot"))
        .when(n > ONE_HOT_VALUES, F.lit("encoding.frequency"))
    )
    known = ("label", "one_hot", "ordinal", "frequency", "target")
    return _result(
        profile.categorical.withColumn("operation_key", key)
        .withColumn("alternatives", _others(F.col("operation_key"), *[f"encoding.{k}" for k in known]))
        .withColumn("reason", F.format_string("%d categories", n)),
        "encoding",
    )


def scaling(profile: Profile) -> DataFrame:
    spread = F.coalesce("outlier_count", F.lit(0)) > 0
    even = F.abs("skewness") < NEARLY_SYMMETRIC
    key = (
        F.when(spread, F.lit("scaling.robust"))
        .when(even, F.lit("scaling.standard"))
        .otherwise(F.lit("scaling.minmax"))
    )
    known = ("standard", "minmax", "robust", "maxabs")
    return _result(
        profile.statistics
        .filter(F.col("is_numeric"))
        .withColumn("operation_key", key)
        .withColumn("alternatives", _others(F.col("operation_key"), *[f"scaling.{k}" for k in known]))
        .withColumn(
            "reason",
            F.when(spread, F.lit("it has outliers"))
            .when(even, F.lit("it is nearly symmetric"))
            .otherwise(F.lit("it is bounded and has no outliers")),
        ),
        "scaling",
    )


def skew(profile: Profile) -> DataFrame:
    positive = F.col("minimum") > 0
    key = F.when(positive, F.lit("skew.boxcox")).otherwise(F.lit("skew.yeojohnson"))
    return _result(
        profile.numeric.filter(F.abs("skewness") > SKEWED)
        .withColumn("operation_key", key)
        .withColumn(
            "alternatives",
            F.when(positive, _keys("skew.log_transform", "skew.sqrt_transform", "skew.yeojohnson")).otherwise(
                _keys("skew.log_transform")
            ),
        )
        .withColumn("reason", F.format_string("skewness is %.2f", "skewness")),
        "skew",
    )


def text(profile: Profile, facts: DataFrame | None = None) -> DataFrame:
    facts = _text_facts(profile) if facts is None else facts
    wordy = (F.col("mean_words") > TEXT_WORDS) | (F.col("mean_length") > TEXT_LENGTH)
    known = (
        "remove_punctuation", "remove_numbers", "remove_stopwords", "remove_extra_spaces", "tokenize",
        "lemmatize", "stem", "tfidf", "bow",
    )
    return _result(
        facts.select(
            "column_name",
            F.when(wordy, F.lit("text.lowercase")).alias("operation_key"),
            _keys(*[f"text.{k}" for k in known]).alias("alternatives"),
            F.format_string("%.1f words and %.0f characters on average", "mean_words", "mean_length").alias("reason"),
        ),
        "text",
    )


def recommend(profile: Profile) -> DataFrame:
    """category, column_name, operation_key, alternatives, reason: all recommendations."""
    facts = _text_facts(profile)
    parts = [
        missing_values(profile),
        duplicates(profile),
        type_conversion(profile, facts),
        outliers(profile),
        encoding(profile),
        scaling(profile),
        skew(profile),
        text(profile, facts),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
