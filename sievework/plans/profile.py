"""Statistical profile of a table.

The profile needs four looks at the data, whatever the number of columns: one
wide aggregation (counts and moments), one value-frequency shuffle (distinct
values, most frequent value, samples), the quartiles, and one count of the rows
outside the fences.  Each look returns one row per column at most; those small
results are kept as tables and everything derived from a profile
(recommendations, insights, key figures) works on them without another scan.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, functions as F, types as T

from sievework.errors import UnknownColumnError
from sievework.functions.columns import (
    as_double,
    categorical_columns,
    local_table,
    nan_to_null,
    numeric_columns,
    quoted,
    text_columns,
    type_of,
)
from sievework.functions.frequencies import column_summaries
from sievework.functions.moments import kurtosis, skewness
from sievework.functions.parsing import value_kind
from sievework.functions.quantiles import exact_quantiles
from sievework.operators import outliers
from sievework.operators.aggregates import duplicate_count

HIGH_CARDINALITY = 0.5
_COLUMNS_PER_SCAN = 60


def _text(value) -> str | None:
    if value is None:
        return None
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e15:
        return f"{value:.1f}"
    return str(value)


@dataclass
class Profile:
    """Profile tables of ``df``; each look at the data happens once, when first needed."""

    df: DataFrame

    @property
    def spark(self):
        return self.df.sparkSession

    @cached_property
    def _counts(self) -> dict:
        """Row count, and per column the filled cells and moments."""
        df, found = self.df, {None: 0}
        names = df.columns or []
        # Column groups: each scan reads its own columns only, and plans stay small on wide tables.
        for at in range(0, max(1, len(names)), _COLUMNS_PER_SCAN):
            group, aggregates = names[at : at + _COLUMNS_PER_SCAN], [F.count(F.lit(1)).alias("rows")]
            for i, name in enumerate(group):
                aggregates.append(F.count(quoted(name)).alias(f"n_{i}"))
                if name in self.numeric_names_all:
                    x = as_double(df, name)
                    for label, value in (
                        ("mean", F.avg(x)),
                        ("min", F.min(x)),
                        ("max", F.max(x)),
                        ("sd", F.stddev_samp(x)),
                        ("var", F.var_samp(x)),
                        ("skew", skewness(x)),
                        ("kurt", kurtosis(x)),
                    ):
                        aggregates.append(value.alias(f"{label}_{i}"))
            row = df.agg(*aggregates).first().asDict()
            found[None] = row.pop("rows")
            for key, value in row.items():
                label, i = key.rsplit("_", 1)
                found.setdefault(group[int(i)], {})[label] = value
        return found

    @cached_property
    def numeric_names_all(self) -> list[str]:
        return numeric_columns(self.df)

    @cached_property
    def numeric_names(self) -> list[str]:
        """Numeric columns that hold at least one value."""
        return [c for c in self.numeric_names_all if self._counts[c]["n"] > 0]

    @cached_property
    def categorical_names(self) -> list[str]:
        return categorical_columns(self.df)

    @cached_property
    def _values(self) -> dict[str, dict]:
        known = [f.name for f in self.df.schema.fields if not isinstance(f.dataType, T.NullType)]
        empty = {"distinct": 0, "top": None, "top_count": 0, "smallest": []}
        return {c: empty for c in self.df.columns} | column_summaries(self.df, known)

    @cached_property
    def _quartiles(self) -> dict[str, list[float | None]]:
        filled = {c: self._counts[c]["n"] for c in self.numeric_names}
        return exact_quantiles(self.df, {c: [0.25, 0.5, 0.75] for c in filled}, filled)

    @cached_property
    def _duplicates(self) -> int:
        return int(duplicate_count(self.df).first()[0])

    @cached_property
    def _mixed(self) -> dict[str, list[str]]:
        names = text_columns(self.df)
        if not names:
            return {}
        row = self.df.agg(
            *[
                F.sort_array(F.collect_set(F.when(quoted(c).isNotNull(), value_kind(quoted(c))))).alias(f"k{i}")
                for i, c in enumerate(names)
            ]
        ).first()
        return {c: row[f"k{i}"] for i, c in enumerate(names) if len(row[f"k{i}"]) > 1}

    def _missing(self, name: str) -> int:
        return self._counts[None] - self._counts[name]["n"]

    def _share(self, part: float) -> float:
        rows = self._counts[None]
        return part / rows * 100 if rows else 0.0

    @cached_property
    def overview(self) -> DataFrame:
        """One row: rows, columns, missing cells, duplicate rows, column kinds."""
        return local_table(
            self.spark,
            [
                (
                    self._counts[None],
                    len(self.df.columns),
                    sum(self._missing(c) for c in self.df.columns),
                    self._duplicates,
                    len(self.numeric_names),
                    len(self.categorical_names),
                )
            ],
            "row_count long, column_count long, total_missing_values long, total_duplicate_rows long, "
            "numeric_column_count long, categorical_column_count long",
        )

    @cached_property
    def columns(self) -> DataFrame:
        """One row per column: type, missing, distinct, up to five smallest values."""
        return local_table(
            self.spark,
            [
                (
                    i + 1,
                    c,
                    type_of(self.df, c).simpleString(),
                    self._missing(c) > 0,
                    self._missing(c),
                    self._share(self._missing(c)),
                    self._values[c]["distinct"],
                    [_text(v) for v in self._values[c]["smallest"]],
                )
                for i, c in enumerate(self.df.columns)
            ],
            "ordinal int, column_name string, dtype string, nullable boolean, missing_count long, "
            "missing_percentage double, unique_count long, sample_values array<string>",
        )

    @cached_property
    def numeric(self) -> DataFrame:
        """One row per numeric column with values."""
        rows = []
        for i, c in enumerate(self.df.columns):
            if c not in self.numeric_names:
                continue
            s, (q1, median, q3) = self._counts[c], self._quartiles[c]
            rows.append(
                (i + 1, c, s["n"], s["mean"], median, float(self._values[c]["top"]), s["min"], s["max"],
                 s["sd"], s["var"], s["max"] - s["min"], q1, q3, q3 - q1, s["skew"], s["kurt"])
            )
        return local_table(
            self.spark,
            rows,
            "ordinal int, column_name string, count long, mean double, median double, mode double, minimum double, "
            "maximum double, std_deviation double, variance double, range double, q1 double, q3 double, "
            "iqr double, skewness double, kurtosis double",
        )

    @cached_property
    def categorical(self) -> DataFrame:
        """One row per non-numeric column."""
        rows, total = [], self._counts[None]
        for i, c in enumerate(self.df.columns):
            if c not in self.categorical_names:
                continue
            v = self._values[c]
            ratio = v["distinct"] / total if total else 0.0
            rows.append(
                (i + 1, c, v["distinct"], _text(v["top"]), v["top_count"], ratio, self._share(self._missing(c)))
            )
        return local_table(
            self.spark,
            rows,
            "ordinal int, column_name string, unique_count long, most_frequent_value string, "
            "most_frequent_value_count long, cardinality_ratio double, missing_percentage double",
        )

    @cached_property
    def quality(self) -> DataFrame:
        """One row per column: constant, empty, single-valued, high cardinality, mixed kinds."""
        rows, total = [], self._counts[None]
        for i, c in enumerate(self.df.columns):
            distinct, missing = self._values[c]["distinct"], self._missing(c)
            ratio = distinct / total if total else 0.0
            category = c in self.categorical_names
            rows.append(
                (i + 1, c, distinct + (missing > 0) <= 1, missing == total, distinct == 1,
                 bool(total and category and ratio >= HIGH_CARDINALITY), distinct, ratio,
                 c in self._mixed, self._mixed.get(c))
            )
        return local_table(
            self.spark,
            rows,
            "ordinal int, column_name string, is_constant boolean, is_empty boolean, is_single_value boolean, "
            "is_high_cardinality boolean, unique_count long, cardinality_ratio double, "
            "is_mixed_type boolean, observed_kinds array<string>",
        )

    @cached_property
    def outlier_bounds(self) -> dict[str, outliers.Bounds]:
        return {
            c: outliers.bounds_from_quartiles(self._quartiles[c][0], self._quartiles[c][2])
            for c in self.numeric_names
        }

    @cached_property
    def _outlier_rows(self) -> dict[str, tuple]:
        if not self.numeric_names:
            return {}
        rows = outliers.report(self.df, self.numeric_names, bounds=self.outlier_bounds).collect()
        return {r["column_name"]: r for r in rows}

    @cached_property
    def outliers(self) -> DataFrame:
        """One row per numeric column with values: fences and outlier share."""
        return self.spark.createDataFrame(list(self._outlier_rows.values()), outliers.REPORT_SCHEMA)

    @cached_property
    def statistics(self) -> DataFrame:
        """One row per column with what the rules of recommendations and reports read."""
        rows, total = [], self._counts[None]
        for i, c in enumerate(self.df.columns):
            number, category = c in self.numeric_names, c in self.categorical_names
            far = self._outlier_rows.get(c)
            distinct, missing = self._values[c]["distinct"], self._missing(c)
            rows.append(
                (
                    i + 1,
                    c,
                    missing,
                    self._share(missing),
                    number,
                    self._counts[c]["skew"] if number else None,
                    self._counts[c]["min"] if number else None,
                    far["outlier_count"] if far else None,
                    far["outlier_percentage"] if far else None,
                    distinct if category else None,
                    distinct + (missing > 0) <= 1,
                    bool(total and category and distinct / total >= HIGH_CARDINALITY),
                )
            )
        return local_table(
            self.spark,
            rows,
            "ordinal int, column_name string, missing_count long, missing_percentage double, is_numeric boolean, "
            "skewness double, minimum double, outlier_count long, outlier_percentage double, unique_count long, "
            "is_constant boolean, is_high_cardinality boolean",
        )


def build_profile(df: DataFrame) -> Profile:
    """A profile of ``df``; floating NaN counts as missing."""
    return Profile(nan_to_null(df))


def summary(profile: Profile) -> DataFrame:
    """The profile in one long table: (section, column_name, statistic, value)."""

    def melt(table: DataFrame, section: str, statistics: list[str]) -> DataFrame:
        named = "column_name" in table.columns
        lines = [
            F.struct(F.lit(s).alias("statistic"), F.col(s).cast("double").alias("value")) for s in statistics
        ]
        return table.select(
            F.lit(section).alias("section"),
            (F.col("column_name") if named else F.lit(None).cast("string")).alias("column_name"),
            F.inline(F.array(*lines)),
        )

    parts = [
        melt(profile.overview, "overview", profile.overview.columns),
        melt(profile.numeric, "numeric", profile.numeric.columns[2:]),
        melt(
            profile.categorical,
            "categorical",
            ["unique_count", "most_frequent_value_count", "cardinality_ratio", "missing_percentage"],
        ),
        melt(
            profile.quality,
            "quality",
            ["is_constant", "is_empty", "is_single_value", "is_high_cardinality"],
        ),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def column_information(profile: Profile, columns: list[str] | None = None) -> DataFrame:
    """Column, numeric and categorical profile side by side for the chosen columns."""
    known = profile.df.columns
    chosen = list(columns or known)
    unknown = sorted(set(chosen) - set(known))
    if unknown:
        raise UnknownColumnError("Not in this table: " + ", ".join(unknown))
    numeric = profile.numeric.drop("ordinal")
    categorical = profile.categorical.drop("ordinal", "missing_percentage", "unique_count")
    return (
        profile.columns.filter(F.col("column_name").isin(chosen))
        .join(numeric, "column_name", "left")
        .join(categorical, "column_name", "left")
    )
