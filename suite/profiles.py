"""Profiles, outliers, recommendations, insights, charts and key figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.operators import outliers
from sievework.operators.aggregates import Aggregation
from sievework.plans import charts, recommend, report
from sievework.plans.profile import build_profile, column_information, summary
from sievework.plans.sql import analyze_query
from suite.basics import _LINE_NUMBERS, correlation_sql
from suite.common import GAP_EVENTS, MIXED_GAPS, Suite, gap_events, mixed_gaps, rounded, table, views

suite = Suite()

# -- SQL for a profile ------------------------------------------------------

_COLUMNS = "event_id user_id event_type value rare_value mostly_value props user_text one_value".split()
_NUMBERS = ["event_id", "user_id", "value", "rare_value", "mostly_value"]
_TEXTS = ["event_type", "props", "user_text", "one_value"]
_TYPES = ["bigint", "bigint", "string", "double", "double", "double", "string", "string", "string"]


def _each(origin, names, template):
    """One SELECT per column; {c} is its name and {i} its place."""
    return " union all ".join(
        template.format(c=c, i=_COLUMNS.index(c) + 1 if c in _COLUMNS else 0, t=origin) for c in names
    )


# n, missing %, distinct per column.
_C = _each(
    MIXED_GAPS,
    _COLUMNS,
    "select '{c}' as column_name, {i} as ordinal, count(*) as total, count({c}) as n, count(*) - count({c}) as missing, "
    "(count(*) - count({c})) * 100.0::double / count(*) as missing_percentage, count(distinct {c}) as d from {t}",
)
# Moments and quartiles per numeric column.
_S = _each(
    MIXED_GAPS,
    _NUMBERS,
    "select '{c}' as column_name, {i} as ordinal, count({c}) as n, avg({c})::double as mean, median({c})::double as "
    "median, min({c})::double as lo, max({c})::double as hi, stddev_samp({c}) as sd, var_samp({c}) as var, "
    "quantile_cont({c}, 0.25)::double as q1, quantile_cont({c}, 0.75)::double as q3, skewness({c}) as skew, "
    "kurtosis({c}) as kurt, (select min(v) from (select {c}::double as v, count(*) as k from {t} where {c} is not null "
    "group by 1 qualify rank() over (order by count(*) desc) = 1)) as mode from {t}",
)
_O = _each(
    MIXED_GAPS,
    _NUMBERS,
    "select '{c}' as column_name, count(*) filter (where {c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1)) "
    "as outliers, count(*) as total from {t}, (select q1, q3 from s where column_name = '{c}') group by all",
)
_T = _each(
    MIXED_GAPS,
    _TEXTS,
    "select '{c}' as column_name, {i} as ordinal, count(*) as total, count({c}) as n, count(distinct {c}) as d, "
    "(select v from (select {c} as v, count(*) as k from {t} where {c} is not null group by 1) order by k desc, v "
    "limit 1) as top, (select max(k) from (select count(*) as k from {t} where {c} is not null group by {c})) as "
    "top_count from {t}",
)
_WITH = f"with c as ({_C}), s as ({_S}), o as ({_O}), t as ({_T}) "
_DUPLICATES = f"(select count(*) from {MIXED_GAPS}) - (select count(*) from (select distinct * from {MIXED_GAPS}))"


def _profile(make, digits=4, **by_column):
    return lambda s, d: rounded(make(build_profile(mixed_gaps(s, d))), digits, **by_column)


suite.add(
    "p1_profile_overview",
    _profile(lambda p: p.overview),
    _WITH
    + f"select max(total) as row_count, 9::bigint as column_count, cast(sum(missing) as bigint) as total_missing_values, "
    f"{_DUPLICATES} as total_duplicate_rows, 5::bigint as numeric_column_count, 4::bigint as categorical_column_count from c",
)
suite.add(
    "p2_profile_columns",
    _profile(lambda p: p.columns.withColumn("sample_values", F.array_join("sample_values", ", "))),
    _WITH
    + "select ordinal, column_name, case ordinal "
    + " ".join(f"when {i + 1} then '{t}'" for i, t in enumerate(_TYPES))
    + " end as dtype, missing > 0 as nullable, missing as missing_count, round(missing_percentage, 4) as "
    "missing_percentage, d as unique_count, sample_values from c join ("
    + _each(
        MIXED_GAPS,
        _COLUMNS,
        "select '{c}' as column_name, string_agg(v, ', ' order by x) as sample_values from (select distinct {c} as x, "
        "cast({c} as varchar) as v from {t} where {c} is not null order by {c} limit 5)",
    )
    + ") using (column_name)",
)
suite.add(
    "p3_profile_numeric",
    _profile(lambda p: p.numeric.drop("skewness", "kurtosis"), 4, variance=2),
    _WITH
    + "select ordinal, column_name, n as count, round(mean, 4) as mean, round(median, 4) as median, round(mode, 4) as "
    "mode, round(lo, 4) as minimum, round(hi, 4) as maximum, round(sd, 4) as std_deviation, round(var, 2) as variance, "
    "round(hi - lo, 4) as range, round(q1, 4) as q1, round(q3, 4) as q3, round(q3 - q1, 4) as iqr from s",
)
suite.add(
    "p4_skewness",
    _profile(lambda p: p.numeric.select("column_name", "skewness"), 6),
    _WITH + "select column_name, round(case when n >= 3 then coalesce(skew, 0) end, 6) as skewness from s",
)
suite.add(
    "p5_kurtosis",
    _profile(lambda p: p.numeric.select("column_name", "kurtosis"), 6),
    _WITH + "select column_name, round(case when n >= 4 then coalesce(kurt, 0) end, 6) as kurtosis from s",
)
suite.add(
    "p6_profile_categorical",
    _profile(lambda p: p.categorical),
    _WITH
    + "select ordinal, column_name, d as unique_count, top as most_frequent_value, top_count as "
    "most_frequent_value_count, round(d / total, 4) as cardinality_ratio, round((total - n) * 100.0::double / total, 4) "
    "as missing_percentage from t",
)
suite.add(
    "p7_quality_flags",
    _profile(lambda p: p.quality.select("column_name", "is_constant", "is_empty", "is_single_value")),
    _WITH
    + "select column_name, d + (missing > 0)::int <= 1 as is_constant, n = 0 as is_empty, d = 1 as is_single_value from c",
)
suite.add(
    "p8_quality_high_cardinality",
    lambda s, d: rounded(
        build_profile(table(s, d, "documents")).quality.select("column_name", "is_high_cardinality", "cardinality_ratio")
    ),
    _each(
        "documents",
        ["doc_id", "text", "lang", "source", "n_chars"],
        "select '{c}' as column_name, '{c}' in ('text', 'lang', 'source') and count(distinct {c}) / count(*) >= 0.5 as "
        "is_high_cardinality, round(count(distinct {c}) / count(*), 4) as cardinality_ratio from {t}",
    ),
)
_MIXED_CELLS = (
    "(select event_id, case event_id % 5 when 0 then cast(user_id as varchar) when 1 then cast(value as varchar) "
    "when 2 then 'true' when 3 then '2024-01-02' else event_type end as cell, event_type from events)"
)


def _mixed_cells(s, d):
    e, m = table(s, d, "events"), F.col("event_id") % 5
    cell = (
        F.when(m == 0, F.col("user_id").cast("string"))
        .when(m == 1, F.col("value").cast("string"))
        .when(m == 2, F.lit("true"))
        .when(m == 3, F.lit("2024-01-02"))
        .otherwise(F.col("event_type"))
    )
    return e.select("event_id", cell.alias("cell"), "event_type")


suite.add(
    "p9_quality_mixed_types",
    lambda s, d: build_profile(_mixed_cells(s, d)).quality.select(
        "column_name", "is_mixed_type", F.array_join("observed_kinds", ",").alias("kinds")
    ),
    "select 'event_id' as column_name, false as is_mixed_type, null::varchar as kinds union all select 'event_type', false, null "
    "union all select 'cell', count(distinct kind) > 1, string_agg(distinct kind, ',' order by kind) from (select case "
    "when regexp_matches(cell, '^[0-9]+$') then 'int' when try_cast(cell as double) is not null then 'float' when cell "
    f"in ('true', 'false') then 'bool' when try_cast(cell as date) is not null then 'timestamp' else 'text' end as kind "
    f"from {_MIXED_CELLS})",
)
suite.add(
    "p10_iqr_bounds",
    lambda s, d: rounded(outliers.bounds_table(mixed_gaps(s, d)), 6),
    _WITH
    + "select column_name, round(q1, 6) as q1, round(q3, 6) as q3, round(q3 - q1, 6) as iqr, "
    "round(q1 - 1.5 * (q3 - q1), 6) as lower_bound, round(q3 + 1.5 * (q3 - q1), 6) as upper_bound from s",
)
suite.add(
    "p11_outlier_report",
    lambda s, d: rounded(outliers.report(mixed_gaps(s, d)).select("column_name", "outlier_count", "outlier_percentage")),
    _WITH
    + "select column_name, outliers as outlier_count, round(outliers * 100.0::double / total, 4) as outlier_percentage from o",
)


def _positions(s, d):
    p = build_profile(mixed_gaps(s, d))
    found = outliers.sample_positions(p.df, "event_id", p.outlier_bounds)
    return found.select("column_name", F.array_join(F.transform("keys", lambda k: k["event_id"].cast("string")), ",").alias("keys"))


suite.add(
    "p11_outlier_positions",
    _positions,
    _WITH
    + "select column_name, string_agg(event_id, ',' order by event_id) as keys from ("
    + _each(
        MIXED_GAPS,
        _NUMBERS,
        "(select '{c}' as column_name, x.event_id from {t} x, (select q1, q3 from s where column_name = '{c}') where "
        "{c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1) order by x.event_id limit 50)",
    )
    + ") group by 1",
)
suite.add(
    "p12_outlier_rows",
    lambda s, d: outliers.outlier_rows(gap_events(s, d), "value", "event_id").rows.select("event_id", "value"),
    f"with q as (select quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from {GAP_EVENTS}) select "
    f"event_id, value from {GAP_EVENTS}, q where value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1) "
    "order by event_id limit 500",
)
suite.add(
    "p12_outlier_total",
    lambda s, d: outliers.outlier_rows(gap_events(s, d), "value", "event_id").total,
    f"with q as (select quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from {GAP_EVENTS}) select "
    f"count(*) as row_count from {GAP_EVENTS}, q where value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1)",
)


def _melt(section, origin, pairs):
    return " union all ".join(
        f"select '{section}' as section, {'column_name' if origin != 'v' else 'null'} as column_name, "
        f"'{name}' as statistic, round(({value})::double, 2) as value from {origin}"
        for name, value in pairs
    )


suite.add(
    "p13_summary",
    lambda s, d: rounded(summary(build_profile(mixed_gaps(s, d))), 2),
    _WITH
    + f", v as (select max(total) as rows, sum(missing) as missing, {_DUPLICATES} as dup from c) "
    + _melt(
        "overview",
        "v",
        [
            ("row_count", "rows"), ("column_count", "9"), ("total_missing_values", "missing"),
            ("total_duplicate_rows", "dup"), ("numeric_column_count", "5"), ("categorical_column_count", "4"),
        ],
    )
    + " union all "
    + _melt(
        "numeric",
        "s",
        [
            ("count", "n"), ("mean", "mean"), ("median", "median"), ("mode", "mode"), ("minimum", "lo"),
            ("maximum", "hi"), ("std_deviation", "sd"), ("variance", "var"), ("range", "hi - lo"), ("q1", "q1"),
            ("q3", "q3"), ("iqr", "q3 - q1"), ("skewness", "skew"), ("kurtosis", "kurt"),
        ],
    )
    + " union all "
    + _melt(
        "categorical",
        "t",
        [
            ("unique_count", "d"), ("most_frequent_value_count", "top_count"), ("cardinality_ratio", "d / total"),
            ("missing_percentage", "(total - n) * 100.0::double / total"),
        ],
    )
    + " union all "
    + _melt(
        "quality",
        "c",
        [
            ("is_constant", "(d + (missing > 0)::int <= 1)::int"), ("is_empty", "(n = 0)::int"),
            ("is_single_value", "(d = 1)::int"),
            (
                "is_high_cardinality",
                "(column_name in ('event_type', 'props', 'user_text', 'one_value') and d / total >= 0.5)::int",
            ),
        ],
    ),
)
suite.add(
    "p14_column_information",
    lambda s, d: rounded(
        column_information(build_profile(mixed_gaps(s, d)), ["value", "event_type"]).select(
            "column_name", "missing_count", "unique_count", "mean", "q1", "most_frequent_value", "most_frequent_value_count"
        )
    ),
    _WITH
    + "select column_name, c.missing as missing_count, c.d as unique_count, round(s.mean, 4) as mean, round(s.q1, 4) as "
    "q1, t.top as most_frequent_value, t.top_count as most_frequent_value_count from c left join s using (column_name) "
    "left join t using (column_name) where column_name in ('value', 'event_type')",
)


def _analyze(s, d):
    views(s, d, "orders")
    _, profile = analyze_query(s, "select o_orderstatus, o_totalprice from orders where o_orderpriority = '1-URGENT'")
    return rounded(profile.numeric.select("column_name", "count", "mean", "median", "q1", "q3"))


suite.add(
    "q4_analyze_query",
    _analyze,
    "select 'o_totalprice' as column_name, count(*) as count, round(avg(o_totalprice), 4) as mean, "
    "round(median(o_totalprice), 4) as median, round(quantile_cont(o_totalprice, 0.25), 4) as q1, "
    "round(quantile_cont(o_totalprice, 0.75), 4) as q3 from orders where o_orderpriority = '1-URGENT'",
)

# -- recommendations --------------------------------------------------------


def _keys(make):
    def query(s, d):
        return make(build_profile(mixed_gaps(s, d))).select(
            "category", "column_name", "operation_key", F.array_join("alternatives", ",").alias("alternatives")
        )

    return query


def _except(category, keys, chosen):
    """Alternatives: all keys but the chosen one."""
    return f"array_to_string(list_filter([{', '.join(repr(f'{category}.{k}') for k in keys)}], lambda x: x <> {chosen}), ',')"


suite.add(
    "rm_recommend_missing",
    _keys(recommend.missing_values),
    _WITH
    + "select 'missing_values' as category, column_name, 'missing_values.' || split_part(r, ' ', 1) as operation_key, "
    "array_to_string(list_transform(list_slice(string_split(r, ' '), 2, 9), lambda x: 'missing_values.' || x), ',') as "
    "alternatives from (select c.column_name, case when missing_percentage > 60 then 'drop_columns drop_rows' when s.n is "
    "not null and missing_percentage <= 5 and (outliers > 0 or abs(skew) >= 1) then 'median mean knn interpolate' when "
    "s.n is not null and missing_percentage <= 5 then 'mean median interpolate' when s.n is not null and "
    "missing_percentage <= 30 then 'knn missforest median' when s.n is not null then 'missforest knn drop_columns' when "
    "missing_percentage <= 5 then 'mode constant drop_rows' else 'constant mode drop_columns' end as r from c left join s "
    "using (column_name) left join o using (column_name) where missing > 0)",
)


def _recommend_duplicates(s, d):
    found = recommend.duplicates(build_profile(table(s, d, "documents").select("text", "lang", "source")))
    return found.select("category", "operation_key", "reason")


suite.add(
    "rd_recommend_duplicates",
    _recommend_duplicates,
    "select 'duplicates' as category, 'duplicates.remove' as operation_key, n || ' of ' || total || ' rows repeat another "
    "row' as reason from (select count(*) as total, count(*) - (select count(*) from (select distinct text, lang, source "
    "from documents)) as n from documents) where n > 0",
)
_TEXT_CELLS = (
    "(select event_type, props, cast(user_id as varchar) as whole, cast(value as varchar) as fraction, "
    "strftime(ts, '%Y-%m-%d %H:%M:%S') as moment, event_type || event_id as name from events)"
)


def _text_cells(s, d):
    return table(s, d, "events").select(
        "event_type",
        "props",
        F.col("user_id").cast("string").alias("whole"),
        F.col("value").cast("string").alias("fraction"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("moment"),
        F.concat("event_type", F.col("event_id").cast("string")).alias("name"),
    )




def _types_sql(origin):
    return (
        "select column_name, 'type_conversion.' || key as operation_key from (select column_name, case when num >= 0.95 "
        "and frac = 0 then 'to_integer' when num >= 0.95 then 'to_float' when dates >= 0.95 then 'to_datetime' when d <= "
        "0.5 then 'to_category' end as key from (select column_name, avg((try_cast(v as double) is not null)::int) as "
        "num, count(*) filter (where try_cast(v as double) % 1 <> 0) as frac, avg((try_cast(v as timestamp) is not "
        f"null)::int) as dates, count(distinct v) / count(*) as d from (unpivot {origin} on columns(*) into name "
        "column_name value v) group by 1)) where key is not null"
    )


def _text_sql(origin):
    return (
        "select column_name, 'text.lowercase' as operation_key from (select column_name, "
        r"avg(len(list_filter(regexp_split_to_array(v, '\s+'), lambda w: w <> ''))) as w, avg(length(v)) as l from "
        f"(unpivot {origin} on columns(*) into name column_name value v) group by 1) where w > 3 or l > 30"
    )


suite.add(
    "rc_recommend_type",
    lambda s, d: recommend.type_conversion(build_profile(_text_cells(s, d))).select("column_name", "operation_key"),
    _types_sql(_TEXT_CELLS),
)
suite.add(
    "ru_recommend_outliers",
    _keys(recommend.outliers),
    _WITH
    + "select 'outliers' as category, column_name, k as operation_key, "
    + _except("outliers", ["remove", "iqr_capping", "winsorization", "zscore_filter", "log_transform"], "k")
    + " as alternatives from (select column_name, case when outliers * 100.0 / o.total < 1 then 'outliers.remove' when "
    "abs(skew) >= 1 then 'outliers.log_transform' else 'outliers.iqr_capping' end as k from o join s using (column_name) "
    "where outliers > 0)",
)
suite.add(
    "re_recommend_encoding",
    _keys(recommend.encoding),
    _WITH
    + "select 'encoding' as category, column_name, k as operation_key, "
    + _except("encoding", ["label", "one_hot", "ordinal", "frequency", "target"], "k")
    + " as alternatives from (select column_name, case when d = 2 then 'encoding.label' when d <= 10 then "
    "'encoding.one_hot' else 'encoding.frequency' end as k from t where d > 1)",
)
suite.add(
    "rn_recommend_scaling",
    _keys(recommend.scaling),
    _WITH
    + "select 'scaling' as category, column_name, k as operation_key, "
    + _except("scaling", ["standard", "minmax", "robust", "maxabs"], "k")
    + " as alternatives from (select column_name, case when outliers > 0 then 'scaling.robust' when abs(skew) < 0.5 then "
    "'scaling.standard' else 'scaling.minmax' end as k from o join s using (column_name))",
)
suite.add(
    "rw_recommend_skew",
    _keys(recommend.skew),
    _WITH
    + "select 'skew' as category, column_name, case when lo > 0 then 'skew.boxcox' else 'skew.yeojohnson' end as "
    "operation_key, case when lo > 0 then 'skew.log_transform,skew.sqrt_transform,skew.yeojohnson' else "
    "'skew.log_transform' end as alternatives from s where abs(skew) > 1",
)
suite.add(
    "rt_recommend_text",
    lambda s, d: recommend.text(build_profile(table(s, d, "documents"))).select("column_name", "operation_key"),
    _text_sql("(select text, lang, source from documents)"),
)
_MIXED_TEXTS = f"(select event_type, props, user_text, one_value from {MIXED_GAPS})"
suite.add(
    "r_recommend_all",
    lambda s, d: recommend.recommend(build_profile(mixed_gaps(s, d))).select("category", "column_name", "operation_key"),
    " union all ".join(
        f"select category, column_name, operation_key from ({suite.sql[name]})"
        for name in (
            "rm_recommend_missing",
            "ru_recommend_outliers",
            "re_recommend_encoding",
            "rn_recommend_scaling",
            "rw_recommend_skew",
        )
    )
    + f" union all select 'duplicates', null, 'duplicates.remove' where {_DUPLICATES} > 0"
    + f" union all select 'type_conversion', column_name, operation_key from ({_types_sql(_MIXED_TEXTS)})"
    + f" union all select 'text', column_name, operation_key from ({_text_sql(_MIXED_TEXTS)})",
)

# -- charts and key figures -------------------------------------------------

suite.add(
    "v1_chart_histogram",
    lambda s, d: rounded(charts.histogram(table(s, d, "orders"), "o_totalprice"), 6),
    "with p as (select min(o_totalprice) as lo, max(o_totalprice) as hi, least(40, greatest(10, count(*) // 20)) as n "
    "from orders), b as (select unnest(range((select n from p))) as bucket), h as (select least(n - 1, "
    "floor((o_totalprice - lo) / ((hi - lo) / n))) as bucket, count(*) as k from orders, p group by 1) select "
    "b.bucket::int as bucket, round(lo + b.bucket * ((hi - lo) / n), 6) as lower, round(lo + (b.bucket + 1) * ((hi - lo) "
    "/ n), 6) as upper, coalesce(k, 0) as count from b cross join p left join h on h.bucket = b.bucket",
)
suite.add(
    "v2_chart_scatter",
    lambda s, d: charts.scatter(table(s, d, "lineitem"), "l_quantity", "l_extendedprice"),
    "select l_quantity as x, l_extendedprice as y from lineitem",
)
suite.add(
    "v3_chart_line",
    lambda s, d: charts.line(table(s, d, "events"), "ts", "value"),
    "select ts as x, value as y from events order by ts",
)
suite.add(
    "v4_chart_bar_counts",
    lambda s, d: charts.bar(mixed_gaps(s, d), "props"),
    f"select props as label, count(*) as value from {MIXED_GAPS} where props is not null group by 1 "
    "order by 2 desc, 1 limit 10",
)
suite.add(
    "v4_chart_bar_sums",
    lambda s, d: rounded(charts.bar(mixed_gaps(s, d), "event_type", "value")),
    f"select event_type as label, round(coalesce(sum(value), 0), 4) as value from {MIXED_GAPS} group by 1 "
    "order by 2 desc, 1 limit 10",
)
suite.add(
    "v5_chart_pie",
    lambda s, d: charts.pie(mixed_gaps(s, d), "event_type"),
    f"select coalesce(event_type, 'Missing') as label, count(*) as value from {MIXED_GAPS} group by 1 "
    "order by 2 desc, 1 limit 8",
)
suite.add(
    "v6_chart_box",
    lambda s, d: rounded(charts.box(gap_events(s, d), "value")),
    f"with q as (select quantile_cont(value, 0.25) as q1, median(value) as median, quantile_cont(value, 0.75) as q3 from "
    f"{GAP_EVENTS}), x as (select *, coalesce(value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1), false) as far "
    f"from {GAP_EVENTS}, q) select round(min(value), 4) as minimum, round(any_value(q1), 4) as q1, "
    "round(any_value(median), 4) as median, round(any_value(q3), 4) as q3, round(max(value), 4) as maximum, "
    "round(min(value) filter (where not far), 4) as lower_whisker, round(max(value) filter (where not far), 4) as "
    "upper_whisker, count(*) filter (where far) as outlier_count from x",
)
suite.add(
    "v7_chart_heatmap",
    lambda s, d: charts.heatmap(table(s, d, "lineitem"), _LINE_NUMBERS),
    correlation_sql("lineitem", _LINE_NUMBERS, "value", 4),
)
suite.add(
    "k4_chart_to_table_heatmap",
    lambda s, d: charts.chart_to_table("heatmap", charts.heatmap(table(s, d, "lineitem"), _LINE_NUMBERS)),
    "select column_x as \"Variable\", "
    + ", ".join(f"max(value) filter (where column_y = '{c}') as {c}" for c in _LINE_NUMBERS)
    + f" from ({correlation_sql('lineitem', _LINE_NUMBERS, 'value', 4)}) group by 1",
)
suite.add(
    "k4_chart_to_table_pie",
    lambda s, d: charts.chart_to_table("pie", charts.pie(table(s, d, "orders"), "o_orderpriority")),
    'select o_orderpriority as "Label", count(*) as "Value" from orders group by 1 order by 2 desc, 1 limit 8',
)
suite.add(
    "v8_kpi_default",
    _profile(charts.default_kpis),
    _WITH
    + f", v as (select max(total) as rows, sum(missing) as missing, {_DUPLICATES} as dup from c) select title, "
    "format('{:,}', n::bigint) as value from (select 'Total Records' as title, rows as n from v union all select "
    "'Total Columns', 9 union all select 'Missing Values', missing from v union all select 'Duplicate Rows', dup from v "
    "union all select 'Numeric Columns', 5 union all select 'Categorical Columns', 4)",
)
suite.add(
    "v9_kpi_requested",
    lambda s, d: charts.requested_kpis(
        table(s, d, "lineitem"),
        [
            Aggregation("max", "l_orderkey"),
            Aggregation("sum", "l_linenumber"),
            Aggregation("sum", "l_returnflag"),
            Aggregation("count"),
        ],
    ),
    "select 'Max L Orderkey' as title, max(l_orderkey)::varchar as value from lineitem union all select "
    "'Sum L Linenumber', sum(l_linenumber)::varchar from lineitem union all select 'Count Rows', count(*)::varchar "
    "from lineitem",
)
suite.add(
    "v10_insights",
    lambda s, d: report.insights(build_profile(mixed_gaps(s, d))).select("title", "severity"),
    _WITH
    + ", m as (select round(sum(missing) * 100.0 / sum(total), 2) as share from c) select distinct * from ("
    "select 'Dataset scale' as title, 'info' as severity union all select 'No missing values', 'info' from m where "
    "share = 0 union all select 'Missing data present', case when share >= 20 then 'critical' when share >= 5 then "
    "'warning' else 'info' end from m where share > 0 union all select 'Skewed distributions', 'info' from s where "
    "abs(skew) >= 1 group by all union all select 'Notable outliers', 'warning' from o where outliers * 100.0 / total "
    ">= 5 group by all union all select 'Constant columns', 'warning' from c where d + (missing > 0)::int <= 1 group by "
    "all union all select 'High-cardinality columns', 'info' from t where d / total >= 0.5 group by all union all select "
    f"'Duplicate rows detected', 'info' from m where {_DUPLICATES} > 0)",
)
suite.add(
    "v11_report_recommendations",
    lambda s, d: report.recommendations(build_profile(mixed_gaps(s, d))).select("title", "priority"),
    _WITH
    + ", m as (select sum(missing) * 100.0 / sum(total) as share from c) select distinct * from ("
    "select 'Address missing values' as title, case when share >= 20 then 'high' else 'medium' end as priority from m "
    f"where share > 0 union all select 'Remove duplicate rows', 'medium' from m where {_DUPLICATES} > 0 union all select "
    "'Drop constant columns', 'low' from c where d + (missing > 0)::int <= 1 group by all union all select 'Transform "
    "skewed features', 'medium' from s where abs(skew) >= 1 group by all union all select 'Review outliers', 'medium' "
    "from o where outliers * 100.0 / total >= 5 group by all union all select 'Encode high-cardinality columns "
    "carefully', 'low' from t where d / total >= 0.5 group by all union all select 'Explore correlations', 'low')",
)
suite.add(
    "v12_report_summary",
    _profile(report.report_summary),
    _WITH
    + "select max(total) as row_count, 9::bigint as column_count, 5::bigint as numeric_column_count, 4::bigint as categorical_column_count, "
    "cast(sum(missing) as bigint) as total_missing_values, round(sum(missing) * 100.0::double / sum(total), 2) as "
    f"missing_percentage, {_DUPLICATES} as total_duplicate_rows, 0::bigint as version_count from c",
)
