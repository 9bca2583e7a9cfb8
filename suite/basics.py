"""Sources, filters, aggregates, sorting, SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.functions.columns import json_safe
from sievework.functions.ordering import Order
from sievework.operators.aggregates import (
    Aggregation,
    aggregate,
    category_counts,
    count_distinct,
    duplicate_count,
    group_by,
    measure_by_category,
    numeric_totals,
    value_counts,
)
from sievework.operators.cleaning.base import OperationSpec
from sievework.operators.correlation import correlation
from sievework.operators.filters import Condition, filter_rows, keep_rows
from sievework.operators.sorting import head, paginate, preview, preview_table, sort_rows
from sievework.plans.cleaning import apply_operation
from sievework.plans.sql import query_page, read_only_query
from sievework.session import scratch_path
from sievework.sources.export import export_tables, query_to_dataset
from sievework.sources.metadata import table_row_count
from sievework.sources.readers import load, scan_csv
from sievework.sources.versions import VersionStore
from suite.common import GAP_EVENTS, MIXED_GAPS, Suite, gap_events, mixed_gaps, raw_table, rounded, table, views

suite = Suite()

# -- sources and sinks ------------------------------------------------------


def _scan_csv(spark, d):
    customers = table(spark, d, "customer").select(
        "c_custkey",
        "c_name",
        "c_nationkey",
        F.when(F.col("c_custkey") % 7 == 0, F.lit("NA")).otherwise(F.col("c_acctbal").cast("string")).alias("c_acctbal"),
        F.when(F.col("c_custkey") % 5 == 0, F.lit("n/a")).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
        (F.col("c_nationkey") > 10).cast("string").alias("far"),
        F.lit(None).cast("string").alias("nothing"),
    )
    path = scratch_path(spark, "csv")
    customers.write.option("header", "true").csv(path)
    return scan_csv(spark, path)


suite.add(
    "s1_scan_csv",
    _scan_csv,
    "select c_custkey, c_name, cast(c_nationkey as bigint) as c_nationkey, "
    "case when c_custkey % 7 = 0 then null else c_acctbal end as c_acctbal, "
    "case when c_custkey % 5 = 0 then null else c_mktsegment end as c_mktsegment, "
    "c_nationkey > 10 as far, cast(null as double) as nothing from customer",
)
suite.add("s2_scan_parquet", lambda s, d: table(s, d, "part"), "select * from part")
suite.add(
    "s8_table_row_count",
    lambda s, d: table_row_count(table(s, d, "lineitem")),
    "select count(*) as row_count from lineitem",
)
suite.add(
    "s9_preview_table",
    lambda s, d: preview_table(table(s, d, "orders"), "o_orderkey", page=3, page_size=500).rows,
    "select * from orders order by o_orderkey limit 100 offset 200",
)
suite.add(
    "s9_preview_paging",
    lambda s, d: preview_table(table(s, d, "orders"), "o_orderkey", page=3, page_size=30).info,
    "select count(*) as total_rows, 3 as page, 30 as page_size, "
    "cast(ceil(count(*) / 30.0) as bigint) as total_pages, true as truncated from orders",
)

_STEPS = [
    OperationSpec("missing_values.mean", "value"),
    OperationSpec("encoding.frequency", "event_type"),
]
_STEPS_SQL = (
    f"with g as {GAP_EVENTS}, f as (select event_type, count(*) / (select count(*) from events) as share "
    "from events group by 1) select event_id, user_id, round(f.share, 6) as event_type, "
    "round(coalesce(value, (select avg(value) from g)), 6) as value from g join f using (event_type)"
)


def _versions(spark, d):
    return VersionStore(spark, scratch_path(spark, "versions")), gap_events(spark, d)


def _write_version(spark, d):
    store, base = _versions(spark, d)
    store.apply("events", base, _STEPS)
    return rounded(store.read("events", base).select("event_id", "user_id", "event_type", "value"), 6)


def _version_manifest(spark, d):
    store, base = _versions(spark, d)
    row = store.apply("events", base, _STEPS)
    return row.select(
        "source_id",
        "version_number",
        "row_count",
        "column_count",
        F.inline("operations"),
    ).drop("params", "failed_count", "skewness_before", "skewness_after")


def _read_version(spark, d):
    store, base = _versions(spark, d)
    first = store.apply("events", base, [OperationSpec("missing_values.drop_rows", "value")]).first()
    store.apply("events", base, [OperationSpec("outliers.remove", "value")])
    return store.read("events", base, first["version_id"]).select("event_id", "value")


def _undo_version(spark, d):
    store, base = _versions(spark, d)
    store.apply("events", base, [OperationSpec("missing_values.drop_rows", "value")])
    store.apply("events", base, [OperationSpec("outliers.remove", "value")])
    store.undo_last("events")
    rows = store.read("events", base)
    return store.list_versions("events").select("version_number", "row_count").withColumn(
        "rows_read", rows.agg(F.count(F.lit(1))).scalar()
    )


_COUNTED = [
    OperationSpec("type_conversion.to_float", "amount"),
    OperationSpec("missing_values.drop_rows", "amount"),
    OperationSpec("skew.log_transform", "user_id"),
    OperationSpec("skew.sqrt_transform", "amount"),
]


def _version_accounts(spark, d):
    store = VersionStore(spark, scratch_path(spark, "versions"))
    amount = F.when(F.col("event_id") % 9 == 0, F.lit("n.a.")).when(F.col("event_id") % 4 != 0, F.abs("value").cast("string"))
    base = table(spark, d, "events").select("event_id", "user_id", amount.alias("amount"))
    row = store.apply("events", base, _COUNTED)
    return rounded(row.select(F.posexplode("operations").alias("nth", "o")).select("nth", "o.*").drop("params"), 5)


suite.add(
    "k1_version_accounts",
    _version_accounts,
    "with b as (select event_id, user_id, case when event_id % 9 = 0 then 'n.a.' when event_id % 4 <> 0 then abs(value)::varchar "
    "end as amount, abs(value) as x from events), k as (select * from b where event_id % 9 <> 0 and amount is not null) "
    "select 0 as nth, 'type_conversion.to_float' as operation_key, 'amount' as column_name, (select count(*) from b) as "
    "affected_row_count, (select count(*) from b where event_id % 9 = 0) as failed_count, null::double as skewness_before, "
    "null::double as skewness_after union all select 1, 'missing_values.drop_rows', 'amount', (select count(*) from b) - "
    "(select count(*) from k), null, null, null union all select 2, 'skew.log_transform', 'user_id', count(*), null, "
    "round(skewness(user_id), 5), round(skewness(ln(1 + user_id)), 5) from k union all select 3, 'skew.sqrt_transform', "
    "'amount', count(*), null, round(skewness(x), 5), round(skewness(sqrt(x)), 5) from k",
)
suite.add("k1_write_version", _write_version, _STEPS_SQL)
suite.add(
    "k1_version_manifest",
    _version_manifest,
    "select 'events' as source_id, 1 as version_number, (select count(*) from events) as row_count, "
    "6 as column_count, u.operation_key, u.column_name, case when u.operation_key like 'missing%' then (select "
    "count(*) from events where event_id % 7 = 0) else (select count(*) from events) end as affected_row_count from "
    "(values ('missing_values.mean', 'value'), ('encoding.frequency', 'event_type')) u(operation_key, column_name)",
)
suite.add(
    "s10_read_version", _read_version, f"select event_id, value from {GAP_EVENTS} where value is not null"
)
suite.add(
    "l4_undo_last",
    _undo_version,
    "select 1 as version_number, count(*) as row_count, count(*) as rows_read from events where event_id % 7 <> 0",
)

_REVENUE = (
    "select l_returnflag, l_linestatus, count(*) as n, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue "
    "from lineitem where l_quantity > 10 group by l_returnflag, l_linestatus"
)


def _query_to_dataset(spark, d):
    views(spark, d, "lineitem")
    return load(spark, query_to_dataset(spark, _REVENUE, scratch_path(spark, "query")))


def _export_tables(spark, d):
    orders = table(spark, d, "orders")
    paths = export_tables(
        {
            "Orders by status": group_by(orders, ["o_orderstatus"], [Aggregation("count")]).groups,
            "Orders by priority": value_counts(orders, "o_orderpriority")[0].withColumnRenamed("value", "o_orderstatus")
            .withColumnRenamed("count", "count_1"),
        },
        scratch_path(spark, "export"),
        "csv",
    )
    parts = [
        scan_csv(spark, path).withColumn("title", F.lit(title)).select("title", "o_orderstatus", "count_1")
        for title, path in paths.items()
    ]
    return parts[0].unionByName(parts[1])


def _export_documents(spark, sf_dir):
    paths = export_tables({"documents": table(spark, sf_dir, "documents")}, scratch_path(spark, "export"), "csv")
    return scan_csv(spark, paths["documents"])


suite.add("k3_export_documents_csv", _export_documents, "select * from documents")
suite.add("k2_query_to_dataset", _query_to_dataset, _REVENUE)
suite.add(
    "k3_export_tables",
    _export_tables,
    "select 'Orders by status' as title, o_orderstatus, count(*) as count_1 from orders group by all "
    "union all select 'Orders by priority', o_orderpriority, count(*) from orders group by all",
)

# -- filters and projections ------------------------------------------------


def _filter(name, table_name, column, operator, value, where):
    suite.add(
        name,
        lambda s, d: keep_rows(raw_table(s, d, table_name), [Condition(column, operator, value)]),
        f"select * from {table_name} where {where}",
    )


_filter("f1_filter_eq", "lineitem", "l_returnflag", "=", "R", "l_returnflag = 'R'")
suite.add(
    "f2_filter_ne",
    lambda s, d: keep_rows(gap_events(s, d), [Condition("value", "!=", "6.55")]).select("event_id", "value"),
    f"select event_id, value from {GAP_EVENTS} where value is distinct from 6.55",
)
_filter("f3_filter_gt", "lineitem", "l_quantity", ">", "45", "l_quantity > 45")
_filter("f4_filter_ge", "lineitem", "l_discount", ">=", 0.09, "l_discount >= 0.09::double")
_filter("f5_filter_lt", "orders", "o_orderdate", "<", "1996-01-01", "o_orderdate < timestamp '1996-01-01'")
_filter("f6_filter_le", "orders", "o_totalprice", "<=", "50000", "o_totalprice <= 50000")
_filter("f7_filter_contains", "part", "p_name", "contains", "R[EI]", "regexp_matches(p_name, 'R[EI]', 'i')")
_filter("f8_filter_starts_with", "part", "p_name", "starts_with", "small", "starts_with(p_name, 'small')")
_filter("f9_filter_ends_with", "part", "p_name", "ends_with", "bolt", "ends_with(p_name, 'bolt')")

_CONDITIONS = [
    Condition("o_orderstatus", "is", "F"),
    Condition("o_totalprice", ">", "100000"),
    Condition("o_orderpriority", "contains", "urgent|high"),
    Condition("o_orderdate", ">=", "1997-01-01"),
]
_CONDITIONS_SQL = (
    "from orders where o_orderstatus = 'F' and o_totalprice > 100000 and "
    "regexp_matches(o_orderpriority, 'urgent|high', 'i') and o_orderdate >= timestamp '1997-01-01'"
)
suite.add(
    "f10_filter_rows",
    lambda s, d: filter_rows(raw_table(s, d, "orders"), _CONDITIONS, order_by="o_orderkey").rows,
    f"select * {_CONDITIONS_SQL} order by o_orderkey limit 50",
)
suite.add(
    "f10_filter_total",
    lambda s, d: filter_rows(raw_table(s, d, "orders"), _CONDITIONS).total,
    f"select count(*) as row_count {_CONDITIONS_SQL}",
)
suite.add(
    "j1_drop_column",
    lambda s, d: apply_operation(table(s, d, "supplier"), "missing_values.drop_columns", "s_name"),
    "select s_suppkey, s_nationkey, s_acctbal from supplier",
)
suite.add(
    "j2_preview_columns",
    lambda s, d: preview(mixed_gaps(s, d))[0].drop("dtype"),
    " union all ".join(
        f"select {i + 1} as ordinal, '{c}' as column_name, count(*) as row_count, 9 as column_count, "
        f"count(*) - count({c}) as missing_count from {MIXED_GAPS}"
        for i, c in enumerate(
            "event_id user_id event_type value rare_value mostly_value props user_text one_value".split()
        )
    ),
)
suite.add(
    "j2_preview_rows",
    lambda s, d: preview(gap_events(s, d), order_by="event_id")[1],
    f"select * from {GAP_EVENTS} order by event_id limit 10",
)
suite.add(
    "j3_json_safe",
    lambda s, d: json_safe(gap_events(s, d)),
    "select event_id, case when strftime(ts, '%f') = '000000' then strftime(ts, '%Y-%m-%dT%H:%M:%S') "
    f"else strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') end as ts, user_id, event_type, value, props from {GAP_EVENTS}",
)

# -- aggregates -------------------------------------------------------------


def _aggregate(name, operation, column, expression, gaps=True):
    source = gap_events if gaps else (lambda s, d: table(s, d, "lineitem"))
    origin = GAP_EVENTS if gaps else "lineitem"
    suite.add(
        name,
        lambda s, d: rounded(aggregate(source(s, d), [Aggregation(operation, column, "result")])),
        f"select {expression} as result from {origin}",
    )


_aggregate("a1_agg_sum", "sum", "value", "round(coalesce(sum(value), 0), 4)")
_aggregate("a2_agg_avg", "avg", "value", "round(avg(value), 4)")
_aggregate("a3_agg_min", "min", "value", "round(min(value), 4)")
_aggregate("a4_agg_max", "max", "value", "round(max(value), 4)")
_aggregate("a5_agg_count", "count", "value", "count(value)")
_aggregate("a6_agg_median", "median", "l_extendedprice", "round(median(l_extendedprice), 4)", gaps=False)
suite.add(
    "a7_aggregate",
    lambda s, d: rounded(
        aggregate(
            table(s, d, "lineitem"),
            [
                Aggregation("count"),
                Aggregation("sum", "l_quantity"),
                Aggregation("avg", "l_discount"),
                Aggregation("median", "l_tax"),
                Aggregation("min", "l_orderkey"),
                Aggregation("max", "l_partkey"),
            ],
        )
    ),
    "select count(*) as count_1, round(sum(l_quantity), 4) as sum_l_quantity, round(avg(l_discount), 4) as "
    "avg_l_discount, round(median(l_tax), 4) as median_l_tax, min(l_orderkey) as min_l_orderkey, "
    "max(l_partkey) as max_l_partkey from lineitem",
)
suite.add(
    "a8_group_by",
    lambda s, d: rounded(
        group_by(
            table(s, d, "lineitem"),
            ["l_returnflag", "l_linestatus"],
            [
                Aggregation("sum", "l_quantity"),
                Aggregation("avg", "l_extendedprice"),
                Aggregation("median", "l_extendedprice"),
                Aggregation("count", None, "n"),
            ],
        ).rows
    ),
    "select l_returnflag, l_linestatus, round(sum(l_quantity), 4) as sum_l_quantity, round(avg(l_extendedprice), 4) "
    "as avg_l_extendedprice, round(median(l_extendedprice), 4) as median_l_extendedprice, count(*) as n "
    "from lineitem group by all order by 3 desc limit 50",
)
suite.add(
    "a8_group_by_gaps",
    lambda s, d: rounded(
        group_by(
            mixed_gaps(s, d), ["event_type", "user_id"], [Aggregation("sum", "rare_value"), Aggregation("max", "props")]
        ).rows
    ),
    f"select event_type, user_id, round(coalesce(sum(rare_value), 0), 4) as sum_rare_value, max(props) as max_props "
    f"from {MIXED_GAPS} group by all order by coalesce(sum(rare_value), 0) desc, event_type nulls last, "
    "user_id nulls last limit 50",
)
suite.add(
    "a8_group_total",
    lambda s, d: group_by(mixed_gaps(s, d), ["event_type", "user_id"]).total,
    f"select count(*) as group_count from (select distinct event_type, user_id from {MIXED_GAPS})",
)
suite.add(
    "a9_value_counts",
    lambda s, d: value_counts(mixed_gaps(s, d), "user_id", 10, include_missing=True)[0],
    f"select user_id as value, count(*) as count from {MIXED_GAPS} group by 1 order by 2 desc, 1 nulls last limit 10",
)
suite.add(
    "a10_count_distinct",
    lambda s, d: count_distinct(mixed_gaps(s, d), "user_id", include_missing=True),
    f"select count(distinct user_id) + max(case when user_id is null then 1 else 0 end) as unique_value_count "
    f"from {MIXED_GAPS}",
)

_LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def correlation_sql(origin: str, names: list[str], value: str = "correlation", digits: int = 6) -> str:
    parts = [
        f"select '{x}' as column_x, '{y}' as column_y, round(case when isnan(corr({x}, {y})) then null else "
        f"greatest(-1, least(1, corr({x}, {y}))) end, {digits}) as {value} from {origin}"
        for x in names
        for y in names
    ]
    return " union all ".join(parts)


suite.add(
    "a11_correlation",
    lambda s, d: rounded(correlation(table(s, d, "lineitem"), _LINE_NUMBERS), 6),
    correlation_sql("lineitem", _LINE_NUMBERS),
)
_GAP_NUMBERS = ["event_id", "user_id", "value", "rare_value"]
suite.add(
    "a11_correlation_gaps",
    lambda s, d: rounded(correlation(mixed_gaps(s, d), _GAP_NUMBERS), 6),
    correlation_sql(MIXED_GAPS, _GAP_NUMBERS),
)


def _spearman_sql(origin, names):
    parts = []
    for x in names:
        for y in names:
            parts.append(
                f"select '{x}' as column_x, '{y}' as column_y, round(corr(rx, ry), 6) as correlation from (select "
                f"rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 as rx, "
                f"rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 as ry from (select {x} as x, "
                f"{y} as y from {origin} where {x} is not null and {y} is not null))"
            )
    return " union all ".join(parts)


suite.add(
    "a12_correlation_spearman",
    lambda s, d: rounded(correlation(gap_events(s, d), ["user_id", "value"], "spearman"), 6),
    _spearman_sql(GAP_EVENTS, ["user_id", "value"]),
)
_LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
suite.add(
    "a12_correlation_spearman_lineitem",
    lambda s, d: rounded(correlation(table(s, d, "lineitem"), _LINE_NUMBERS, "spearman"), 6),
    _spearman_sql("lineitem", _LINE_NUMBERS),
)


def _kendall_sql(origin, names):
    parts = []
    for x in names:
        for y in names:
            parts.append(
                f"select '{x}' as column_x, '{y}' as column_y, round(sum(sign(a.{x} - b.{x}) * sign(a.{y} - b.{y})) / "
                f"(sqrt(sum(abs(sign(a.{x} - b.{x})))) * sqrt(sum(abs(sign(a.{y} - b.{y}))))), 6) as correlation "
                f"from {origin} a, {origin} b"
            )
    return " union all ".join(parts)


suite.add(
    "a13_correlation_kendall",
    lambda s, d: rounded(correlation(table(s, d, "customer"), ["c_custkey", "c_nationkey", "c_acctbal"], "kendall"), 6),
    _kendall_sql("customer", ["c_custkey", "c_nationkey", "c_acctbal"]),
)
_FIVE = ["c_custkey", "c_nationkey", "c_acctbal", "seventh", "gap"]


def _five(s, d):
    key = F.col("c_custkey")
    return table(s, d, "customer").select(
        *_FIVE[:3], (key % 7).alias("seventh"), F.when(key % 5 != 0, F.round(F.col("c_acctbal") / 500)).alias("gap")
    )


_FIVE_SQL = (
    "(select c_custkey, c_nationkey, c_acctbal, c_custkey % 7 as seventh, "
    "case when c_custkey % 5 <> 0 then round(c_acctbal / 500) end as gap from customer)"
)


def _kendall_gaps_sql(origin, names):
    parts = []
    for x in names:
        for y in names:
            sx, sy = f"sign(a.{x} - b.{x})", f"sign(a.{y} - b.{y})"
            both = f"{sx} is not null and {sy} is not null"
            parts.append(
                f"select '{x}' as column_x, '{y}' as column_y, round(sum({sx} * {sy}) / (sqrt(sum(abs({sx})) filter ({both})) "
                f"* sqrt(sum(abs({sy})) filter ({both}))), 6) as correlation from g a, g b"
            )
    return f"with g as {origin} " + " union all ".join(parts)


suite.add(
    "a13_correlation_kendall_five",
    lambda s, d: rounded(correlation(_five(s, d), _FIVE, "kendall"), 6),
    _kendall_gaps_sql(_FIVE_SQL, _FIVE),
)
suite.add(
    "a12_correlation_spearman_five",
    lambda s, d: rounded(correlation(_five(s, d), _FIVE, "spearman"), 6),
    _spearman_sql(_FIVE_SQL, _FIVE),
)
suite.add(
    "a14_numeric_aggregates_table",
    lambda s, d: rounded(numeric_totals(mixed_gaps(s, d))),
    f"select column_name, round(sum(v), 4) as sum, round(avg(v), 4) as mean, round(min(v), 4) as min, "
    f"round(max(v), 4) as max, round(median(v), 4) as median from (unpivot (select event_id::double as event_id, "
    f"user_id::double as user_id, value, rare_value, mostly_value from {MIXED_GAPS}) on columns(*) into name "
    "column_name value v) group by 1",
)
suite.add(
    "a15_category_counts_tables",
    lambda s, d: category_counts(mixed_gaps(s, d)),
    f"with c as (select column_name, value, count(*) as count from (unpivot (select event_type, props, user_text, "
    f"one_value from {MIXED_GAPS}) on columns(*) into name column_name value value) group by all) select * from c "
    "where column_name in (select column_name from c group by 1 having count(*) <= 50) qualify row_number() over "
    "(partition by column_name order by count desc, value) <= 15",
)
suite.add(
    "a16_measure_by_category",
    lambda s, d: rounded(measure_by_category(mixed_gaps(s, d), "event_type", "value")),
    f"select event_type, round(coalesce(sum(value), 0), 4) as total from {MIXED_GAPS} group by 1 "
    "order by 2 desc, 1 limit 20",
)
suite.add(
    "a17_duplicate_count",
    lambda s, d: duplicate_count(table(s, d, "documents").select("text", "lang", "source")),
    "select count(*) - (select count(*) from (select distinct text, lang, source from documents)) as duplicate_rows "
    "from documents",
)

# -- sorting and pages ------------------------------------------------------

suite.add(
    "o1_sort_rows",
    lambda s, d: sort_rows(gap_events(s, d), "value", ascending=False, tie_break="event_id"),
    f"select * from {GAP_EVENTS} order by value desc nulls last, event_id limit 50",
)
suite.add(
    "o1_sort_rows_ascending",
    lambda s, d: sort_rows(gap_events(s, d), "value", tie_break="event_id"),
    f"select * from {GAP_EVENTS} order by value nulls last, event_id limit 50",
)
suite.add(
    "o2_head",
    lambda s, d: head(table(s, d, "orders"), "o_orderkey", 5),
    "select * from orders order by o_orderkey limit 5",
)
suite.add(
    "o3_paginate",
    lambda s, d: paginate(table(s, d, "orders"), "o_orderkey", page=4, page_size=700).rows,
    "select * from orders order by o_orderkey limit 700 offset 2100",
)
suite.add(
    "o3_paginate_deep",
    lambda s, d: paginate(
        table(s, d, "orders"), "o_orderkey", page=10, page_size=1000, shallow=1000, rows_per_range=2000
    ).rows,
    "select * from orders order by o_orderkey limit 1000 offset 9000",
)
def _long_key(s, d):
    """Keys that a double cannot tell apart."""
    return table(s, d, "orders").withColumn("k", F.col("o_orderkey").cast("decimal(38,0)") + F.lit("1e30").cast("decimal(38,0)"))


suite.add(
    "o3_paginate_decimal",
    lambda s, d: paginate(_long_key(s, d), "k", page=10, page_size=1000, shallow=1000, rows_per_range=2000).rows.drop("k"),
    "select * from orders order by o_orderkey limit 1000 offset 9000",
)
suite.add(
    "o3_paginate_text_descending",
    lambda s, d: paginate(
        table(s, d, "customer"), Order("c_name", False), page=2, page_size=500, shallow=100, rows_per_range=200
    ).rows,
    "select * from customer order by c_name desc limit 500 offset 500",
)
suite.add(
    "o3_paginate_info",
    lambda s, d: paginate(table(s, d, "orders"), "o_orderkey", page=1, page_size=700).info,
    "select count(*) as total_rows, 1 as page, 700 as page_size, cast(ceil(count(*) / 700.0) as bigint) as "
    "total_pages, true as truncated from orders",
)

# -- read-only SQL ----------------------------------------------------------


def _sql(name, text, *names, oracle=None):
    def query(spark, d):
        views(spark, d, *names)
        return read_only_query(spark, text)

    suite.add(name, query, oracle or text)


_sql(
    "q1_sql_query",
    "with big as (select * from orders where o_totalprice > 200000) select o_orderpriority, count(*) as n, "
    "round(sum(o_totalprice), 2) as total from big group by o_orderpriority -- totals\n;",
    "orders",
    oracle="select o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as total from orders "
    "where o_totalprice > 200000 group by o_orderpriority",
)


def _query_page(spark, d):
    views(spark, d, "orders")
    return query_page(spark, "select * from orders where o_orderstatus = 'F'", "o_orderkey", 2, 40).rows


suite.add(
    "q1_sql_page",
    _query_page,
    "select * from orders where o_orderstatus = 'F' order by o_orderkey limit 40 offset 40",
)
_sql(
    "q5_sql_join_inner",
    "select c_mktsegment, count(*) as n, round(sum(o_totalprice), 2) as total from customer join orders "
    "on c_custkey = o_custkey group by c_mktsegment",
    "customer",
    "orders",
)
_sql(
    "q5_sql_join_left",
    "select c_custkey, count(o_orderkey) as n from customer left join orders on c_custkey = o_custkey and "
    "o_orderstatus = 'P' group by c_custkey",
    "customer",
    "orders",
)
_sql(
    "q5_sql_join_right",
    "select r_name, count(n_nationkey) as n from nation right join region on n_regionkey = r_regionkey and "
    "n_nationkey > 3 group by r_name",
    "nation",
    "region",
)
_sql(
    "q5_sql_join_full",
    "select c_custkey, s_suppkey from (select * from customer where c_acctbal > 5000) c full join supplier "
    "on c_custkey = s_suppkey",
    "customer",
    "supplier",
)
_sql(
    "q5_sql_join_semi",
    "select o_orderkey, o_totalprice from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey "
    "and l_quantity > 49)",
    "orders",
    "lineitem",
)
_sql(
    "q5_sql_join_anti",
    "select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)",
    "orders",
    "lineitem",
)
_sql(
    "q5_sql_join_theta",
    "select o_orderpriority, count(*) as n from orders join lineitem on o_orderkey = l_orderkey and "
    "l_shipdate < o_orderdate group by o_orderpriority",
    "orders",
    "lineitem",
)
_sql(
    "q5_sql_join_star",
    "select r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join orders on "
    "l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join "
    "region on n_regionkey = r_regionkey group by r_name, n_name",
    "lineitem",
    "orders",
    "customer",
    "nation",
    "region",
)
_LITERALS = "select o_orderkey, '--x' as a, 'b /* c */ d' as b from orders where o_orderpriority <> 'a--b' -- end"
suite.add(
    "q1_sql_literals",
    lambda s, d: read_only_query(s, _LITERALS.replace(" -- end", "; -- end"), {"orders": raw_table(s, d, "orders")}),
    _LITERALS,
)
_sql(
    "q1_sql_union",
    "select c_nationkey as k from customer union select s_nationkey from supplier",
    "customer",
    "supplier",
)
_sql(
    "q1_sql_union_all",
    "select c_nationkey as k from customer union all select s_nationkey from supplier",
    "customer",
    "supplier",
)
_sql(
    "q1_sql_intersect",
    "select c_nationkey as k from customer intersect select s_nationkey from supplier",
    "customer",
    "supplier",
)
_sql(
    "q1_sql_except",
    "select o_orderkey as k from orders except select l_orderkey from lineitem",
    "orders",
    "lineitem",
)
_sql(
    "q1_sql_except_all",
    "select c_nationkey as k from customer except all select s_nationkey from supplier",
    "customer",
    "supplier",
)
_sql(
    "q1_sql_row_number",
    "select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) "
    "as rn from orders",
    "orders",
    oracle="select o_custkey, o_orderkey, cast(row_number() over (partition by o_custkey order by o_totalprice desc, "
    "o_orderkey) as int) as rn from orders",
)
_sql(
    "q1_sql_rank",
    "select p_partkey, rank() over (partition by p_brand order by p_size) as r, dense_rank() over "
    "(partition by p_brand order by p_size) as dr from part",
    "part",
    oracle="select p_partkey, cast(rank() over (partition by p_brand order by p_size) as int) as r, "
    "cast(dense_rank() over (partition by p_brand order by p_size) as int) as dr from part",
)
_sql(
    "q1_sql_lag",
    "select event_id, user_id, lag(value) over (partition by user_id order by ts, event_id) as previous, "
    "lead(event_type) over (partition by user_id order by ts, event_id) as next_type from events",
    "events",
)
_sql(
    "q1_sql_running_sum",
    "select o_custkey, o_orderkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderkey rows "
    "between unbounded preceding and current row), 2) as running from orders",
    "orders",
)
_sql(
    "q1_sql_rollup",
    "select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as quantity from lineitem "
    "group by rollup (l_returnflag, l_linestatus)",
    "lineitem",
)
_sql(
    "q1_sql_cube",
    "select o_orderstatus, o_orderpriority, count(*) as n from orders group by cube (o_orderstatus, o_orderpriority)",
    "orders",
)
_sql(
    "q1_sql_grouping_sets",
    "select o_orderstatus, o_orderpriority, count(*) as n from orders group by grouping sets "
    "((o_orderstatus), (o_orderpriority), ())",
    "orders",
)
