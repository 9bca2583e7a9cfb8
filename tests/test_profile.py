"""Profile facts of small tables with known answers."""

import math

import pytest

from sievework.errors import NotNumericError, UnknownColumnError, UnknownMethodError
from sievework.functions.columns import json_safe
from sievework.operators import outliers
from sievework.operators.sorting import preview
from sievework.plans.profile import build_profile, column_information
from sievework.plans.recommend import recommend
from sievework.plans.report import insights, recommendations, report_summary, report_tables
from sievework.plans.charts import default_kpis, requested_kpis
from sievework.operators.aggregates import Aggregation
from sievework.sources.export import export_tables
from sievework.sources.readers import scan_csv


@pytest.fixture(scope="module")
def people(spark):
    rows = [
        (10, "A", "X", None, "p1"),
        (11, "A", "X", None, "p2"),
        (9, "A", None, None, "p3"),
        (10, "A", None, None, "p4"),
        (1000, "A", "X", None, "p5"),
        (10, "A", "X", None, "p1"),
    ]
    schema = "value long, category string, half_null string, empty_col void, text_id string"
    return build_profile(spark.createDataFrame(rows, schema))


def rows(df):
    return {r["column_name"]: r for r in df.collect()}


def test_overview(people):
    found = people.overview.first()
    assert (found["row_count"], found["column_count"]) == (6, 5)
    assert found["total_missing_values"] == 8
    assert found["total_duplicate_rows"] == 1
    assert (found["numeric_column_count"], found["categorical_column_count"]) == (1, 3)


def test_quality(people):
    found = rows(people.quality)
    assert {c for c, r in found.items() if r["is_constant"]} == {"category", "empty_col"}
    assert {c for c, r in found.items() if r["is_empty"]} == {"empty_col"}
    assert {c for c, r in found.items() if r["is_single_value"]} == {"category", "half_null"}
    assert {c for c, r in found.items() if r["is_high_cardinality"]} == {"text_id"}


def test_numeric_and_outliers(people):
    found = rows(people.numeric)["value"]
    assert found["mean"] == 175.0 and found["minimum"] == 9.0 and found["maximum"] == 1000.0
    assert found["mode"] == 10.0
    assert rows(people.outliers)["value"]["outlier_count"] == 1


def test_outlier_positions_and_errors(spark):
    df = spark.createDataFrame(list(enumerate([10, 11, 9, 10, 1000, 10])), "n long, x long")
    found = outliers.sample_positions(df, "n", outliers.iqr_bounds(df, ["x"])).first()
    assert [k["n"] for k in found["keys"]] == [4]
    assert outliers.outlier_rows(df, "x", "n").total.first()[0] == 1
    with pytest.raises(UnknownMethodError):
        outliers.report(df, ["x"], method="none")
    with pytest.raises(UnknownColumnError):
        outliers.outlier_rows(df, "y", "n")
    with pytest.raises(NotNumericError):
        outliers.outlier_rows(df.selectExpr("n", "cast(x as string) x"), "x", "n")


def test_boolean_is_a_category(spark):
    df = spark.createDataFrame([(True, 10), (False, 20), (True, 30), (True, 40)], "flag boolean, amount long")
    profile = build_profile(df)
    assert profile.numeric_names == ["amount"] and profile.categorical_names == ["flag"]


def test_mixed_types(spark):
    df = spark.createDataFrame([("1", "A"), ("two", "A"), ("3.5", "A"), ("four", "A")], "mixed string, constant string")
    found = rows(build_profile(df).quality)
    assert found["mixed"]["is_mixed_type"] and found["mixed"]["observed_kinds"] == ["float", "int", "text"]
    assert found["constant"]["is_constant"] and not found["constant"]["is_mixed_type"]


def test_constant_small_and_empty_columns(spark):
    df = spark.createDataFrame([(5.0, 1.0), (5.0, 2.0), (5.0, None), (5.0, None)], "same double, few double")
    found = rows(build_profile(df).numeric)
    assert found["same"]["skewness"] == 0.0 and found["same"]["kurtosis"] == 0.0
    assert found["few"]["skewness"] is None and found["few"]["kurtosis"] is None
    one = rows(build_profile(df.limit(1).select("same")).numeric)["same"]
    assert one["std_deviation"] is None and one["skewness"] is None
    empty = build_profile(df.limit(0))
    assert empty.overview.first()["row_count"] == 0
    assert empty.numeric.count() == 0 and empty.outliers.count() == 0
    assert recommend(empty).count() >= 0


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (math.nan,), (3.0,)], "x double")
    found = build_profile(df)
    assert found.columns.first()["missing_count"] == 1
    assert rows(found.numeric)["x"]["mean"] == 2.0
    assert [r["x"] for r in json_safe(df).collect()] == [1.0, None, 3.0]


def test_column_information(people):
    found = column_information(people, ["value"]).collect()
    assert len(found) == 1 and found[0]["mean"] == 175.0
    with pytest.raises(UnknownColumnError):
        column_information(people, ["nothing"])


def test_preview(spark):
    df = spark.createDataFrame(
        [("north", 100.0, None), ("south", 200.0, "ok"), ("east", None, "pending")],
        "region string, revenue double, notes string",
    )
    columns, first = preview(df)
    found = rows(columns)
    assert found["revenue"]["missing_count"] == 1 and found["region"]["row_count"] == 3
    assert first.count() == 3


CLEANING = [
    (10.0, "A", "This is a fairly long free text note about something"),
    (11.0, "A", "Another fairly long free text note about something else"),
    (None, "A", "Yet another long piece of free text describing an event"),
    (10.0, "B", "Some more descriptive text goes here for testing"),
    (1000.0, "B", "Extra long free text sample for the outlier row here"),
    (10.0, "A", "This is a fairly long free text note about something"),
]


@pytest.fixture(scope="module")
def cleaning(spark):
    return build_profile(spark.createDataFrame(CLEANING, "value double, category string, note string"))


def test_recommendations_by_category(cleaning):
    found = recommend(cleaning).collect()
    by_category = {}
    for r in found:
        by_category.setdefault(r["category"], []).append((r["column_name"], r["operation_key"]))
    assert [c for c, _ in by_category["missing_values"]] == ["value"]
    assert by_category["duplicates"] == [(None, "duplicates.remove")]
    assert ("note", "text.lowercase") in by_category["text"]
    assert ("category", "encoding.label") in by_category["encoding"]
    assert ("value", "scaling.robust") in by_category["scaling"]
    assert ("value", "skew.boxcox") in by_category["skew"]
    assert ("value", "outliers.log_transform") in by_category["outliers"]


def test_report(cleaning, spark, folder):
    titles = {r["title"]: r["severity"] for r in insights(cleaning).collect()}
    assert titles["Dataset scale"] == "info" and "Missing data present" in titles
    assert titles["Duplicate rows detected"] == "warning" and titles["Skewed distributions"] == "info"
    assert "Address missing values" in {r["title"] for r in recommendations(cleaning).collect()}
    assert report_summary(cleaning).first()["missing_percentage"] == pytest.approx(5.56)
    few = build_profile(
        spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4), ("b", 5), ("b", 6)], "k string, n long")
    )
    assert [r["title"] for r in recommendations(few).collect()] == ["Dataset is analysis-ready"]
    paths = export_tables(report_tables(few), folder, "csv")
    assert {"KPIs", "Dataset", "Insights", "Histogram"} <= set(paths)
    assert scan_csv(spark, paths["Dataset"]).count() == 6


def test_kpis(spark):
    df = spark.createDataFrame(
        [("north", 100), ("south", 200), ("north", 150), ("east", 50)], "region string, sales long"
    )
    cards = requested_kpis(df, [Aggregation("sum", "sales"), Aggregation("sum", "region")]).collect()
    assert [(c["title"], c["value"]) for c in cards] == [("Sum Sales", "500")]
    assert requested_kpis(df, [Aggregation("sum", "region")]).count() == 0
    assert default_kpis(build_profile(df)).count() == 6
