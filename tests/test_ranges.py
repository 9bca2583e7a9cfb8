"""Ordered work and quantiles: the paths for large data, forced on small data."""

import random
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from sievework.functions import quantiles
from sievework.functions.frequencies import attach, column_summaries
from sievework.functions.ordering import Order, page_of, with_position, with_range
from sievework.functions.quantiles import exact_quantiles, grouped_quantiles

PROBABILITIES = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


def values(kind, n):
    generator = random.Random(kind)
    if kind == "hot":  # one value holds a third of all rows
        return [7.0 if i % 3 == 0 else generator.gauss(0, 100) for i in range(n)]
    if kind == "few":
        return [float(generator.choice([1, 2, 2, 3])) for _ in range(n)]
    if kind == "same":
        return [4.0] * n
    return [generator.lognormvariate(0, 2) for _ in range(n)]


@pytest.mark.parametrize("kind", ["hot", "few", "same", "wide"])
def test_quantiles_by_narrowing(spark, kind):
    data = values(kind, 3000)
    df = spark.createDataFrame([(v,) for v in [*data, None]], "x double")
    found = exact_quantiles(df, {"x": PROBABILITIES}, one_state=20)["x"]
    assert found == pytest.approx(list(np.quantile(data, PROBABILITIES)))


def test_quantiles_of_a_wide_table(spark, monkeypatch):
    looked = []
    look = quantiles._look
    monkeypatch.setattr(quantiles, "_look", lambda df, v, group, most: (looked.append([t.inside for t in group]), look(df, v, group, most)))
    monkeypatch.setattr(quantiles, "_HELD_PER_LOOK", 100_000)
    df = spark.range(2_000).select([((F.col("id") * (2 * i + 1)) % 2_003).cast("double").alias(f"x{i}") for i in range(60)])
    found = exact_quantiles(df, {c: [0.25, 0.9] for c in df.columns}, one_state=1_000)
    wanted = df.toPandas().quantile([0.25, 0.9])
    assert all(found[c] == pytest.approx(wanted[c].tolist()) for c in df.columns)
    assert len(looked) > 4
    held = [sum(n if n <= 1_000 else quantiles._ACCURACY for n in group) for group in looked]
    assert max(held) <= 100_000 and max(map(len, looked)) <= 60


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None, 1)], "x double, y long")
    assert exact_quantiles(df, {"x": [0.5], "y": [0.25, 0.5]}) == {"x": [None], "y": [1.0, 1.0]}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-50, 50), min_size=2, max_size=60))
def test_quantiles_of_any_numbers(spark, data):
    df = spark.createDataFrame([(v,) for v in data], "x long")
    found = exact_quantiles(df, {"x": [0.25, 0.5]}, one_state=2)["x"]
    assert found == pytest.approx(list(np.quantile(data, [0.25, 0.5])))


def test_grouped_quantiles(spark):
    generator = random.Random(1)
    rows = [(generator.choice(["a", "a", "a", None, "b"]), generator.gauss(0, 1) if i % 5 else None) for i in range(2000)]
    rows.append(("empty", None))
    df = spark.createDataFrame(rows, "k string, x double")
    pdf = pd.DataFrame(rows, columns=["k", "x"])
    for limit in (10_000, 100):
        found = {r["k"]: (r["m"], r["q"]) for r in grouped_quantiles(df, ["k"], "x", {"m": 0.5, "q": 0.9}, one_state=limit).collect()}
        assert set(found) == {"a", "b", None, "empty"} and found["empty"] == (None, None)
        for key in ("a", "b", None):
            part = pdf[pdf["k"].isna() if key is None else pdf["k"] == key]["x"].dropna()
            assert found[key] == pytest.approx(tuple(np.quantile(part, [0.5, 0.9])))


@pytest.mark.parametrize(
    "keys",
    [["a", "n"], [Order("a", False), "n"], [Order("s"), "n"], ["t", "n"], [Order("s", False), "n"], [Order("n", False)]],
)
def test_positions_follow_the_sort(spark, keys):
    df = spark.range(500).select(
        F.col("id").alias("n"),
        F.when(F.col("id") % 7 != 0, (F.col("id") * 37 % 20).cast("double")).alias("a"),
        F.concat(F.lit("k"), (F.col("id") * 13 % 50).cast("string")).alias("s"),
        F.timestamp_seconds(F.col("id") * 7919 % 100).alias("t"),
    )
    from sievework.functions.ordering import sort_columns

    want = [r["n"] for r in df.orderBy(*sort_columns(keys)).collect()]
    placed = with_position(df, keys, "p", rows_per_range=40)
    assert [r["n"] for r in placed.orderBy("p").collect()] == want
    assert sorted(r["p"] for r in placed.collect()) == list(range(500))


def test_ranges_split_a_hot_first_key(spark):
    """A third of the rows share the first key; the second key still spreads them."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id")).alias("a"), "id")
    ranged, n = with_range(df, ["a", "id"], rows_per_range=150)
    largest = ranged.groupBy("__range").count().agg(F.max("count")).first()[0]
    assert n > 10 and largest < 700


def test_attach_by_every_path(spark):
    rows = [("hot" if i % 3 == 0 else f"k{i % 40}" if i % 5 else None, i) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, i long")
    lookup = df.filter("k is not null and k <> 'k7'").groupBy(F.col("k").alias("key")).agg(
        F.avg("i").alias("value"), F.count(F.lit(1)).alias("n")
    )
    want = {r["key"]: r["value"] for r in lookup.collect()}
    for bound in (1000, 5):
        found = attach(df, "k", lookup, "v", bound).collect()
        assert len(found) == 600
        assert {r["i"]: r["v"] for r in found} == {i: want.get(k) for k, i in rows}


def test_summaries(spark):
    df = spark.createDataFrame([(2, "b", -0.0), (2, "a", 0.0), (1, "a", None), (1, "b", 2.5)], "n long, t string, x double")
    found = column_summaries(df, ["n", "t", "x"])
    assert found["n"] == {"distinct": 2, "top": 1, "top_count": 2, "smallest": [1, 2]}
    assert found["t"]["top"] == "a" and found["x"]["distinct"] == 2 and found["x"]["top"] == 0.0


def test_long_decimals_and_texts_keep_their_order(spark):
    from sievework.functions.frequencies import column_summaries
    from sievework.functions.ordering import Order, page_of, with_position, with_range

    rows = [(i, Decimal(10**29 + i), "p" * 70 + f"{i:04}") for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, k decimal(38,1), t string")
    for key in (["k", "id"], ["t"], [Order("k", False)], [Order("t", False)]):
        back = isinstance(key[0], Order)
        placed = {r["id"]: r["__position"] for r in with_position(df, key, rows_per_range=10).collect()}
        assert placed == {i: 999 - i if back else i for i in range(1000)}
        assert with_range(df, key, rows_per_range=10)[1] > 50
    found = column_summaries(df, ["k"])["k"]
    assert found["distinct"] == 1000 and found["top_count"] == 1 and found["smallest"][1] == Decimal(10**29 + 1)


def test_lookup_by_shuffle_reads_the_table_once(spark):
    from sievework.functions.frequencies import attach

    df = spark.createDataFrame([(i % 40 if i % 9 else None, i) for i in range(500)], "k long, i long")
    lookup = df.filter("k is not null").groupBy("k").count().selectExpr("k as key", "k * 10 as value", "count as n")
    out = attach(df, "k", lookup, "k", bound=3)
    assert {(r["k"], r["i"]) for r in out.collect()} == {(10 * (i % 40) if i % 9 else None, i) for i in range(500)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 1


def test_deep_page_reads_one_key_range(spark):
    rows = [(None if i % 50 == 0 else f"n{i % 2000:05d}", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, id long")
    for ascending in (True, False):
        known = sorted((r for r in rows if r[0] is not None), key=lambda r: r[1])
        known.sort(key=lambda r: r[0], reverse=not ascending)
        want = known + sorted((r for r in rows if r[0] is None), key=lambda r: r[1])
        for offset in (40, 1490, 2930, 2995, 3000):
            page = page_of(df, [Order("k", ascending), "id"], offset, 20, shallow=10, rows_per_range=5)
            assert [tuple(r) for r in page.collect()] == want[offset : offset + 20]
            # The plan does not grow with the ranges of the table.
            assert len(page._jdf.queryExecution().optimizedPlan().toString()) < 20_000


def test_grouped_quantiles_of_few_values_need_no_ranges(spark, monkeypatch):
    rows = [(i % 3 if i % 7 else None, float(i * i % 41) if i % 5 else None) for i in range(4000)]
    pdf = pd.DataFrame(rows, columns=["k", "x"])
    df = spark.createDataFrame(rows, "k long, x double")
    monkeypatch.setattr(quantiles, "with_range", None)
    found = {r["k"]: (r["m"], r["q"]) for r in grouped_quantiles(df, ["k"], "x", {"m": 0.5, "q": 0.9}, one_state=1000).collect()}
    for key in (0, 1, 2, None):
        part = pdf[pdf["k"].isna() if key is None else pdf["k"] == key]["x"].dropna()
        assert found[key] == pytest.approx(tuple(np.quantile(part, [0.5, 0.9])))
