"""Filters, aggregates, correlation, sorting, charts, read-only SQL."""

import itertools
import math
import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sievework import session
from sievework.errors import AggregationError, FilterError, OperationError, ReadOnlyError, UnknownColumnError
from sievework.functions.ordering import Order
from sievework.operators.aggregates import Aggregation, aggregate, count_distinct, group_by, value_counts
from sievework.operators import correlation as correlation_module
from sievework.operators.correlation import correlation
from sievework.operators.filters import Condition, coerce_literal, filter_rows, keep_rows
from sievework.operators.sorting import paginate, sort_rows
from sievework.plans import charts
from sievework.plans.sql import query_page, read_only_query, validate


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame(
        [("north", 100, 1, "new"), ("south", 200, 3, "won"), ("north", 150, 2, "won"), ("east", 50, 4, "new")],
        "region string, revenue long, quantity long, status string",
    )


def test_sales(sales):
    assert {r["value"]: r["count"] for r in value_counts(sales, "status")[0].collect()} == {"new": 2, "won": 2}
    grouped = group_by(sales, ["region"], [])
    assert grouped.total.first()[0] == 3 and grouped.rows.first()["count_1"] == 2
    found = filter_rows(sales, [Condition("region", "=", "north")])
    assert found.total.first()[0] == 2 and found.rows.count() == 2
    assert sort_rows(sales, "revenue", ascending=False).first()["revenue"] == 200
    totals = aggregate(sales, [Aggregation("count"), Aggregation("sum", "revenue")]).first()
    assert totals["count_1"] == 4 and totals["sum_revenue"] == 500
    diagonal = correlation(sales).filter("column_x = column_y").collect()
    assert [r["correlation"] for r in diagonal] == [1.0, 1.0]


def test_filter_rules(spark):
    df = spark.createDataFrame(
        [(1, 1.0, True, "Alpha"), (2, math.nan, False, "beta"), (3, None, None, None)],
        "id long, x double, flag boolean, name string",
    )
    keep = lambda *c: [r["id"] for r in keep_rows(df, [Condition(*c)]).orderBy("id").collect()]
    assert keep("x", "!=", "1") == [2, 3]
    assert keep("x", ">", "0") == [1]
    assert keep("flag", "=", "YES") == [1]
    assert keep("flag", "=", "perhaps") == []
    assert keep("name", "contains", "^AL|ta$") == [1, 2]
    assert keep("name", "starts_with", "al") == []
    assert keep("name", "ends_with", "ta") == [2]
    assert keep("name", "=", None) == [] and keep("name", "!=", None) == [1, 2, 3]
    assert coerce_literal(df, "id", " 12 ") == 12 and coerce_literal(df, "x", "1e3") == 1000.0
    for condition in (Condition("id", "=", "many"), Condition("id", "between", "1")):
        with pytest.raises(FilterError):
            keep_rows(df, [condition])
    with pytest.raises(UnknownColumnError):
        keep_rows(df, [Condition("nothing", "=", 1)])


def test_filter_reaches_the_scan(spark, folder):
    spark.range(100).selectExpr("id", "cast(id as double) as x").write.parquet(folder + "/t")
    df = keep_rows(spark.read.parquet(folder + "/t"), [Condition("x", ">", "90")])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(x,90" in plan


def test_aggregate_rules(spark):
    df = spark.createDataFrame([("a", None), ("a", None), (None, 2.0)], "k string, v double")
    assert aggregate(df.filter("k = 'a'"), [Aggregation("sum", "v")]).first()[0] == 0.0
    grouped = {r["k"]: r["sum_v"] for r in group_by(df, ["k"], [Aggregation("sum", "v")]).groups.collect()}
    assert grouped == {"a": 0.0, None: 2.0}
    assert count_distinct(df, "k", include_missing=True).first()[0] == 2
    for spec in (Aggregation("sum"), Aggregation("mode", "v"), Aggregation("avg", "k"), Aggregation("min", "k")):
        with pytest.raises(AggregationError):
            aggregate(df, [spec])
    with pytest.raises(AggregationError):
        aggregate(df, [])


def test_correlations_against_brute_force(spark):
    random.seed(3)
    rows = [
        (random.choice([1.0, 2.0, 2.0, None, 5.0]), float(random.randint(0, 9)), random.random()) for _ in range(300)
    ]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    pdf = pd.DataFrame(rows, columns=["a", "b", "c"])

    def tau(x, y):
        pairs = [(p, q) for p, q in zip(x, y) if not (pd.isna(p) or pd.isna(q))]
        up = ties_x = ties_y = n = 0
        for (p, q), (r, s) in itertools.combinations(pairs, 2):
            n += 1
            up += np.sign(p - r) * np.sign(q - s)
            ties_x += p == r
            ties_y += q == s
        return up / math.sqrt((n - ties_x) * (n - ties_y))

    for method, options in (("pearson", {}), ("spearman", {"rows_per_range": 20}), ("kendall", {"rows_per_range": 20})):
        found = {(r[0], r[1]): r[2] for r in correlation(df, method=method, **options).collect()}
        assert len(found) == 9
        for x, y in itertools.combinations("abc", 2):
            want = tau(pdf[x], pdf[y]) if method == "kendall" else (
                pdf[[x, y]].dropna().rank().corr().loc[x, y] if method == "spearman" else pdf[x].corr(pdf[y])
            )
            assert found[x, y] == pytest.approx(want, abs=1e-9), (method, x, y)
            assert found[x, y] == found[y, x]


def test_rank_correlation_leaves_no_pair_tables(spark, folder, monkeypatch):
    numbers = np.random.default_rng(6).integers(0, 40, (500, 4)).astype(float)
    df = spark.createDataFrame([tuple(map(float, r)) for r in numbers], "a double, b double, c double, d double")
    gaps = df.withColumn("d", F.when(F.col("a") > 3, F.col("d")))
    monkeypatch.setattr(session, "shared_dir", lambda _: folder)
    for method in ("spearman", "kendall"):
        found = {(r[0], r[1]): r[2] for r in correlation(gaps, method=method, rows_per_range=50).collect()}
        want = gaps.toPandas().corr(method) if method == "spearman" else None
        for x, y in itertools.combinations("abcd", 2):
            if want is not None:
                assert found[x, y] == pytest.approx(want.loc[x, y], abs=1e-9)
            assert found[x, y] == found[y, x]
    left = os.listdir(folder)
    assert not [p for p in left if p.startswith("pairs")]
    assert len([p for p in left if p.startswith("lookup")]) <= 2  # one for each method


def test_rank_correlation_exchanges_do_not_grow_with_columns(spark):
    numbers = np.random.default_rng(6).integers(0, 40, (300, 6)).astype(float)
    df = spark.createDataFrame([tuple(map(float, r)) for r in numbers], ", ".join(f"c{i} double" for i in range(6)))

    def exchanges(n):
        ranked = correlation_module._ranked(df.select([F.col(f"c{i}").alias(f"x{i}") for i in range(n)]), [F.col(f"x{i}") for i in range(n)], "rank")
        return ranked._jdf.queryExecution().executedPlan().toString().count("Exchange")

    assert exchanges(2) == exchanges(6)



def test_correlation_rules(spark):
    df = spark.createDataFrame([(1.0, 7.0, "x"), (2.0, 7.0, "y")], "a double, same double, t string")
    found = {(r[0], r[1]): r[2] for r in correlation(df).collect()}
    assert found["a", "same"] is None and found["same", "same"] is None and found["a", "a"] == 1.0
    with pytest.raises(OperationError):
        correlation(df, ["a", "t"])
    with pytest.raises(OperationError):
        correlation(df, method="other")


def test_pages(spark):
    df = spark.range(50).withColumnRenamed("id", "n")
    page = paginate(df, "n", page=2, page_size=10)
    assert [r["n"] for r in page.rows.collect()] == list(range(10, 20))
    info = page.info.first()
    assert info["total_pages"] == 5 and info["truncated"] and info["total_rows"] == 50
    assert not paginate(df, "n", page_size=100).info.first()["truncated"]
    assert paginate(df, "n", page=-1, page_size=0).info.first()["page_size"] == 1
    deep = paginate(df, Order("n", ascending=False), page=4, page_size=10, shallow=5, rows_per_range=7)
    assert [r["n"] for r in deep.rows.collect()] == list(range(19, 9, -1))
    beyond = paginate(df, "n", page=9, page_size=10, shallow=5, rows_per_range=7)
    assert beyond.rows.count() == 0


def test_missing_last_both_ways(spark):
    df = spark.createDataFrame([(1,), (None,), (2,)], "n long")
    assert [r[0] for r in sort_rows(df, "n").collect()] == [1, 2, None]
    assert [r[0] for r in sort_rows(df, "n", ascending=False).collect()] == [2, 1, None]


def test_charts(spark):
    jobs = spark.createDataFrame(
        [("analyst", "Egypt"), ("engineer", "Germany"), ("analyst", "Egypt"), ("manager", None)],
        "job string, country string",
    )
    assert charts.bar(jobs, "country").first()["label"] == "Egypt"
    assert {r["label"] for r in charts.pie(jobs, "country").collect()} == {"Egypt", "Germany", "Missing"}
    flat = spark.createDataFrame([(3.0,)] * 5, "x double")
    bars = charts.histogram(flat, "x").collect()
    assert len(bars) == 10 and sum(b["count"] for b in bars) == 5


@pytest.mark.parametrize(
    "sql",
    [
        "select o_orderkey, '--' as mark from orders",
        "/*+ hint */ select count(*) from lineitem where l_tax > 0.01 ; ",
        "with big as (select * from part where p_size > 40) select p_brand, 'b /* c */ d' from big -- end",
        "select n_name, \"it''s -- here\" from nation",
    ],
)
def test_reading_statements_run_as_given(sql):
    assert validate(sql) == sql.replace(";", "").strip()


@pytest.mark.parametrize(
    "sql",
    [
        "merge into orders using lineitem on true when matched then delete",
        "select 1 from region; select 2 from region",
        "select '--'; drop view nation",
        "-- select\ntruncate table events",
        "/* with */ alter table part drop column p_size",
        "describe supplier",
        "-- nothing else",
        "select java_method('java.lang.System', 'nanoTime') from region",
        "select `reflect` ('java.util.UUID', 'randomUUID') from region",
        "select '--', try_reflect('java.util.UUID', 'randomUUID')",
    ],
)
def test_other_statements_fail(sql):
    with pytest.raises(ReadOnlyError):
        validate(sql)


def test_views_of_the_session_stay(spark):
    spark.range(3).createOrReplaceTempView("kept_view")
    found = read_only_query(spark, "select count(*) as n from kept_view, other_view", {"kept_view": spark.range(5), "other_view": spark.range(2)})
    assert found.first()["n"] == 10 and spark.table("kept_view").count() == 3
    assert not spark.catalog.tableExists("other_view")


def test_sql_pages(spark):
    spark.range(50).createOrReplaceTempView("numbers")
    page = query_page(spark, "select id from numbers -- all\n;", "id", page=2, page_size=10)
    assert page.rows.first()["id"] == 10 and page.info.first()["total_pages"] == 5
    named = read_only_query(spark, "select count(*) as n from these", {"these": spark.range(3)})
    assert named.first()["n"] == 3


def test_heat_map_reads_its_table_once(spark):
    numbers = np.random.default_rng(3).normal(size=(200, 3))
    df = spark.createDataFrame([tuple(map(float, r)) for r in numbers], "a double, b double, c double")
    wide = df.select([F.col(c).alias(f"x{i}") for i, c in enumerate("abc")])
    plan = correlation_module._pearson(wide, list(itertools.combinations_with_replacement(range(3), 2)))._jdf.queryExecution()
    assert plan.optimizedPlan().toString().count("var_pop(") == 6  # three spreads, three pairs
    table = charts.chart_to_table("heatmap", charts.heatmap(df))
    assert "var_pop" not in table._jdf.queryExecution().optimizedPlan().toString()
    want = pd.DataFrame(numbers, columns=list("abc")).corr().round(4)
    for r in table.collect():
        assert [r[c] for c in "abc"] == pytest.approx(want.loc[r["Variable"]].tolist(), abs=1e-4)


def test_rank_correlation_joins_only_columns_of_many_values(spark, monkeypatch):
    numbers = np.random.default_rng(8).integers(0, 60, (400, 3)).astype(float)
    numbers[:, 2] %= 4
    df = spark.createDataFrame([tuple(map(float, r)) for r in numbers], "a double, b double, c double")
    df = df.withColumn("b", F.when(F.col("a") % 7 != 0, F.col("b")))
    pdf, attach, joined = df.toPandas(), correlation_module.attach, []
    monkeypatch.setattr(correlation_module, "attach", lambda df, *a, **o: (joined.append(df), attach(df, *a, **o))[1])
    for few in (10, 1000):
        monkeypatch.setattr(correlation_module, "_FEW_VALUES", few)
        for names in (["a", "c"], ["a", "b", "c"]):
            found = {(r[0], r[1]): r[2] for r in correlation(df, names, "spearman", rows_per_range=15).collect()}
            for x, y in itertools.combinations(names, 2):
                assert found[x, y] == pytest.approx(pdf[[x, y]].dropna().rank().corr().loc[x, y], abs=1e-9), (few, x, y)
    assert len(joined) == 2 and "explode" not in joined[0]._jdf.queryExecution().analyzed().toString()


def test_discordant_pairs_by_ranges(spark):
    generator = np.random.default_rng(9)
    values, weights = generator.integers(0, 9, 200), generator.integers(1, 5, 200)
    brute = lambda v, w: sum(int(w[i]) * int(w[j]) for i in range(len(v)) for j in range(i + 1, len(v)) if v[i] > v[j])
    assert correlation_module._discordant(values, weights.copy()) == brute(values, weights)
    heavy = weights.astype("int64") << 40  # sums beyond 64 bits
    assert correlation_module._discordant(values, heavy.copy()) == brute(values, heavy)
    rows = spark.createDataFrame([(0, float(x), float(y), 1) for x, y in {tuple(r) for r in generator.integers(0, 40, (300, 2)).tolist()}], "pair int, x double, y double, w long")
    taus = {n: correlation_module._tau(rows, rows_per_range=n).first()["r"] for n in (7, 50, 1000)}
    assert len(set(taus.values())) == 1
    assert "Generate" not in correlation_module._tau(rows, rows_per_range=50)._jdf.queryExecution().optimizedPlan().toString()
