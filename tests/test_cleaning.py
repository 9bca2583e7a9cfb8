"""Cleaning operations: rules at the edges, model-based ones against brute force."""

import math
import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sievework.errors import OperationError, UnknownOperationError
from sievework.functions.stemming import stem
from sievework.functions.text import tokenize
from sievework.operators.cleaning.base import Operation, OperationSpec
from sievework.operators.cleaning import forest, neighbours
from sievework.operators.cleaning.neighbours import neighbour_impute
from sievework.operators.cleaning.skew import skew_change
from sievework.plans import cleaning
from sievework.plans.cleaning import apply_operation, default_catalog, preview_chain, run_chain, watch_chain
from sievework.session import write_step


def column(df, name, order=None):
    return [r[name] for r in (df.orderBy(order) if order else df).collect()]


@pytest.fixture(scope="module")
def numbers(spark):
    data = [(0, None), (1, 2.0), (2, None), (3, None), (4, 8.0), (5, None)]
    return spark.createDataFrame(data, "i long, x double")


def test_catalog(spark):
    catalog = default_catalog()
    assert len(catalog.all()) == 49
    counts = {}
    for r in catalog.table(spark).collect():
        counts[r["category"]] = counts.get(r["category"], 0) + 1
    assert counts == {
        "missing_values": 11, "duplicates": 4, "type_conversion": 5, "outliers": 6, "encoding": 5, "scaling": 4,
        "skew": 4, "text": 10,
    }
    with pytest.raises(UnknownOperationError):
        catalog.get("missing_values.guess")


def test_own_operation(numbers):
    catalog = default_catalog()
    catalog.register(
        Operation("custom.double", "Double", lambda df, c, p, f: df.withColumn(c, F.col(c) * p.get("by", 2)))
    )
    found = run_chain(numbers, [OperationSpec("custom.double", "x", {"by": 3})], catalog).dataframe
    assert column(found, "x", "i") == [None, 6.0, None, None, 24.0, None]


@pytest.mark.parametrize("size", [2, 1000])
def test_fills_follow_pandas(spark, size):
    generator = random.Random(4)
    values = [generator.random() if generator.random() < 0.3 else None for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(values)), "i long, x double").repartition(5)
    series = pd.Series(values, dtype=float)
    for key, want in (
        ("forward_fill", series.ffill()),
        ("backward_fill", series.bfill()),
        ("interpolate", series.interpolate(limit_direction="both")),
    ):
        found = apply_operation(df, f"missing_values.{key}", "x", order_by="i", rows_per_range=size * 10)
        got = pd.Series(column(found, "x", "i"), dtype=float)
        pd.testing.assert_series_equal(got, want, check_names=False)


def test_fill_carries_any_type(spark):
    rows = [(i, f"t\"{i}\"\n" if i % 9 == 0 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "i long, s string").withColumn("t", F.timestamp_micros(F.when(F.col("i") % 9 == 0, F.col("i") * 1234567)))
    for name in ("s", "t"):
        found = apply_operation(df, "missing_values.forward_fill", name, order_by=["i"], rows_per_range=7)
        want = pd.Series(column(df, name, "i")).ffill()
        assert list(column(found, name, "i")) == list(want)


def test_fill_rules(spark, numbers):
    assert column(apply_operation(numbers, "missing_values.mean", "x"), "x", "i") == [5.0, 2.0, 5.0, 5.0, 8.0, 5.0]
    with pytest.raises(OperationError):
        apply_operation(numbers, "missing_values.forward_fill", "x")
    with pytest.raises(OperationError):
        apply_operation(numbers, "missing_values.mean", "nothing")
    empty = numbers.filter("x is null")
    for key in ("mean", "median", "mode"):
        assert set(column(apply_operation(empty, f"missing_values.{key}", "x"), "x")) == {None}
    worded = apply_operation(numbers, "missing_values.constant", "x")
    assert column(worded, "x", "i")[:2] == ["Unknown", "2.0"]
    tie = spark.createDataFrame([("b",), ("a",), (None,)], "k string")
    assert sorted(column(apply_operation(tie, "missing_values.mode", "k"), "k")) == ["a", "a", "b"]


def brute_knn(rows, k):
    data = np.array([[math.nan if v is None else v for v in r] for r in rows], dtype=float)
    out = data.copy()
    for i, row in enumerate(data):
        for c in np.flatnonzero(np.isnan(row)):
            found = []
            for other in data:
                both = ~np.isnan(row) & ~np.isnan(other)
                if not math.isnan(other[c]) and both.any():
                    gap = math.sqrt(len(row) / both.sum() * ((row[both] - other[both]) ** 2).sum())
                    found.append((gap, other[c]))
            out[i, c] = np.mean([v for _, v in sorted(found)[:k]]) if found else np.nanmean(data[:, c])
    return out


@pytest.mark.parametrize("leaf_rows", [10_000, 15])
def test_knn_against_brute_force(spark, leaf_rows):
    generator = random.Random(8)
    rows = []
    for _ in range(160):
        a, b, c = generator.gauss(0, 5), float(generator.randint(0, 3)), generator.random()
        rows.append(tuple(None if generator.random() < 0.2 else v for v in (a, b, c)))
    rows += [(1.0, 2.0, None)] * 20 + [(1.0, 2.0, 0.5)] * 60  # copies of gap rows and of donors
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, a double, b double, c double")
    found = neighbour_impute(df.select(F.col("i").cast("string").alias("i"), "a", "b", "c"), 4, leaf_rows)
    got = found.toPandas().set_index("i")[["a", "b", "c"]]
    want = brute_knn(rows, 4)
    for i in range(len(rows)):
        assert got.loc[str(i)].to_numpy() == pytest.approx(want[i]), (i, rows[i])


def test_knn_visits_few_leaves(spark, monkeypatch):
    """Ten columns, and leaves that lack donors: boxes are visited nearest first, and few of them."""
    rng = np.random.default_rng(12)
    centres = rng.uniform(-50, 50, (40, 10))
    points = centres[rng.integers(0, 40, 2400)] + rng.standard_normal((2400, 10))
    rows = [[float(x) for x in p] for p in points]
    for i in range(0, 2400, 20):
        rows[i][i % 4] = None
    df = spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"c{i} double" for i in range(10)))
    asked = []
    nearest = neighbours._nearest
    monkeypatch.setattr(neighbours, "_nearest", lambda donors, asking, *a: asked.append(asking.count()) or nearest(donors, asking, *a))
    got = sorted(tuple(r) for r in neighbour_impute(df, 5, 20).collect())
    want = sorted(tuple(map(float, r)) for r in brute_knn(rows, 5))
    assert np.allclose(got, want)
    # 120 gap vectors, 128 leaves: the own one and some neighbours each.
    assert sum(asked) < 120 * 20


def test_knn_sends_gaps_to_blocks_not_leaves(spark, monkeypatch):
    """Ten columns without any grouping: a gap vector reaches most small leaves, but is sent to few blocks of them."""
    rng = np.random.default_rng(4)
    rows = [[float(x) for x in p] for p in rng.uniform(0, 50, (1200, 10))]
    for i in range(0, 1200, 20):
        rows[i][i % 3] = None
    df = spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"c{i} double" for i in range(10)))
    asked = []
    nearest = neighbours._nearest
    monkeypatch.setattr(neighbours, "_nearest", lambda donors, asking, *a: asked.append(asking.count()) or nearest(donors, asking, *a))
    got = sorted(tuple(r) for r in neighbour_impute(df, 5, 20).collect())
    want = sorted(tuple(map(float, r)) for r in brute_knn(rows, 5))
    assert np.allclose(got, want)
    assert sum(asked) < 60 * 4


def test_knn_in_many_blocks_and_tasks(spark, monkeypatch):
    """Blocks of 40 donors: missing donor cells, copies, and donors that differ in the target only."""
    monkeypatch.setattr(neighbours, "_BLOCK_ROWS", 40)
    monkeypatch.setattr(neighbours, "_GAPS_PER_TASK", 7)
    rng = np.random.default_rng(6)
    rows = []
    for _ in range(300):
        a, b, c = float(rng.normal(0, 5)), float(rng.integers(0, 4)), float(rng.normal(0, 9))
        rows.append(tuple(None if rng.random() < 0.2 else v for v in (a, b, c)))
    rows += [(1.0, 2.0, float(v)) for v in rng.permutation(200)]
    rows += [(1.0, 2.0, None)] * 30 + [(None, None, None)] * 3 + [(50.0, None, None), (7.5, 1.0, None)]
    df = spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], "i string, a double, b double, c double")
    got = neighbour_impute(df, 4, 10).toPandas().set_index("i")[["a", "b", "c"]]
    want = brute_knn(rows, 4)
    for i in range(len(rows)):
        assert got.loc[str(i)].to_numpy() == pytest.approx(want[i]), (i, rows[i])


@pytest.mark.parametrize("ties", [False, True])
def test_knn_block_needs_little_memory(ties):
    """4,000 gap vectors against 20,000 donors, all equally near or not: arrays stay far below one of all distances."""
    rng = np.random.default_rng(9)
    donors = rng.uniform(0, 100, (20_000, 3))
    asked = rng.uniform(0, 100, (4_000, 3))
    if ties:
        donors[:, :2], asked[:, :2] = 1.0, 1.0
    asked[:, 2] = math.nan
    xs = ["x0", "x1", "x2"]
    have = pd.DataFrame(donors, columns=xs).assign(w=1)
    ask = pd.DataFrame(asked, columns=xs).assign(q=range(4_000), reach=math.inf)
    tracemalloc.start()
    found = neighbours._top_k(ask, have, xs, 2, 5, 400)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
    means = found.groupby("q")["v"].apply(lambda v: v.head(5).mean())
    for q in range(0, 4_000, 400):
        d = np.sqrt(3 / 2 * ((donors[:, :2] - asked[q, :2]) ** 2).sum(axis=1))
        assert means[q] == pytest.approx(donors[np.lexsort((donors[:, 2], d))[:5], 2].mean())


def test_forest_fills_and_keeps_known(spark):
    rows = [(float(i), 3.0 * i + 1, None if i % 6 == 0 else 2.0 * i) for i in range(120)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    found = apply_operation(df, "missing_values.missforest", "c", trees=10)
    out = found.orderBy("a").collect()
    assert len(out) == 120 and all(r["c"] is not None for r in out)
    assert all(r["c"] == 2.0 * r["a"] for r in out if r["a"] % 6)
    assert np.mean([abs(r["c"] - 2 * r["a"]) for r in out if r["a"] % 6 == 0]) < 15


def test_forest_rounds_write_the_gaps_only(spark, monkeypatch):
    """Two columns with gaps among many rows and wide texts; names that the rounds use themselves stand in the table."""
    rows = [(float(i), None if i % 50 == 0 else 2.0 * i, None if i % 70 == 3 else 5.0 - i, "t" * 200, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "x0 double, c1 double, g2 double, open string, row long")
    steps = []

    def watched(state, name):
        written, path = write_step(state, name)
        steps.append((written.columns, written.count()))
        return written, path

    monkeypatch.setattr(forest, "write_step", watched)
    out = forest.forest_impute(df, trees=5, rounds=2)
    n_open = sum(r[1] is None or r[2] is None for r in rows)
    assert len(steps) >= 2 and all(n == n_open and not {"c3", "open"} & set(columns) for columns, n in steps)
    assert out.columns == df.columns and [f.dataType for f in out.schema] == [f.dataType for f in df.schema]
    found = {r["row"]: r for r in out.collect()}
    assert len(found) == 1000
    for x, c, g, text, i in rows:
        assert (found[i]["x0"], found[i]["open"]) == (x, text)
        assert found[i]["c1"] == c if c is not None else abs(found[i]["c1"] - 2.0 * i) < 100
        assert found[i]["g2"] == g if g is not None else abs(found[i]["g2"] - (5.0 - i)) < 50


def test_duplicates(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), (None, None), (None, None), ("b", 2)], "k string, n int")
    for key, left, affected in (("remove", 3, 2), ("keep_last", 3, 2), ("keep_unique", 1, 4)):
        result = run_chain(df, [OperationSpec(f"duplicates.{key}")])
        assert result.dataframe.count() == left
        assert result.outcomes[0].metrics.first()["affected_row_count"] == affected


def test_type_conversion_rules(spark):
    df = spark.createDataFrame([(" 12.0",), ("9007199254740993",), ("x",), (None,), ("1e2",)], "t string")
    assert column(apply_operation(df, "type_conversion.to_integer", "t"), "t") == [12, 9007199254740993, None, None, 100]
    fractional = spark.createDataFrame([("1.5",)], "t string")
    with pytest.raises(Exception, match="no whole number"):
        apply_operation(fractional, "type_conversion.to_integer", "t").collect()
    odd = spark.createDataFrame([("7d",), ("inf",), (" -.5 ",), ("1_0",)], "t string")
    assert column(apply_operation(odd, "type_conversion.to_float", "t"), "t") == [None, math.inf, -0.5, None]
    dates = spark.createDataFrame([("2024-01-02",), ("1/2/2024",), ("02-Jan-2024",), ("Jan 2, 2024",), ("soon 1",)], "t string")
    found = apply_operation(dates, "type_conversion.to_datetime", "t").select(F.date_format("t", "yyyy-MM-dd").alias("t"))
    assert column(found, "t") == ["2024-01-02"] * 4 + [None]
    marked = apply_operation(df, "type_conversion.to_category", "t")
    assert marked.schema["t"].metadata == {"category": True}


def test_outlier_rules(spark):
    df = spark.createDataFrame([(float(v),) for v in (10, 11, 9, 10, 1000, 10)] + [(None,)], "x double")
    assert apply_operation(df, "outliers.remove", "x").count() == 6
    capped = column(apply_operation(df, "outliers.iqr_capping", "x"), "x")
    assert max(v for v in capped if v is not None) < 20 and None in capped
    same = spark.createDataFrame([(3.0,)] * 3, "x double")
    assert apply_operation(same, "outliers.zscore_filter", "x").count() == 3
    with pytest.raises(OperationError):
        apply_operation(spark.createDataFrame([(-1.0,)], "x double"), "outliers.log_transform", "x")
    with pytest.raises(OperationError):
        apply_operation(spark.createDataFrame([("a",)], "x string"), "outliers.keep", "x")


def test_encoding_rules(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 3.0), (None, 5.0), ("b", 2.0)], "k string, y double")
    assert column(apply_operation(df, "encoding.label", "k"), "k", "y") == [1, 1, 0, None]
    wide = apply_operation(df, "encoding.one_hot", "k").orderBy("y").collect()
    assert [(r["k_a"], r["k_b"]) for r in wide] == [(False, True), (False, True), (True, False), (False, False)]
    assert column(apply_operation(df, "encoding.ordinal", "k", order=["b"]), "k", "y") == [0, 0, None, None]
    assert column(apply_operation(df, "encoding.target", "k", target_column="y"), "k", "y") == [1.5, 1.5, 3.0, None]
    assert column(apply_operation(df, "encoding.frequency", "k"), "k", "y") == pytest.approx([2 / 3, 2 / 3, 1 / 3, None])
    for key, params in (("ordinal", {}), ("target", {}), ("one_hot", {"max_categories": 1})):
        with pytest.raises(OperationError):
            apply_operation(df, f"encoding.{key}", "k", **params)


def test_scaling_of_constants(spark):
    df = spark.createDataFrame([(4.0,), (4.0,), (None,)], "x double")
    for key in ("standard", "minmax", "robust"):
        assert column(apply_operation(df, f"scaling.{key}", "x"), "x") == [0.0, 0.0, None]
    assert column(apply_operation(df, "scaling.maxabs", "x"), "x") == [1.0, 1.0, None]


def power_by_search(values, transform, jacobian):
    """The best power by golden-section search in numpy."""
    x, n = np.array(values), len(values)

    def score(p):
        return -n / 2 * math.log(np.var(transform(x, p))) + (p - 1) * jacobian(x).sum()

    low, high, ratio = -3.0, 3.0, (math.sqrt(5) - 1) / 2
    for _ in range(80):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if score(a) > score(b) else (a, high)
    return (low + high) / 2


def test_boxcox(spark):
    generator = random.Random(2)
    for values in ([generator.lognormvariate(0, 1) for _ in range(800)], [generator.uniform(1, 9) ** 2 for _ in range(800)],
                   [1e6 * generator.uniform(1, 2) for _ in range(300)]):
        df = spark.createDataFrame(list(enumerate(values)), "i long, x double")
        boxcox = lambda x, p: np.log(x) if abs(p) < 1e-9 else (x**p - 1) / p
        power = power_by_search(values, boxcox, np.log)
        found = column(apply_operation(df, "skew.boxcox", "x"), "x", "i")
        assert found == pytest.approx(list(boxcox(np.array(values), power)), rel=2e-3)
    with pytest.raises(OperationError):
        apply_operation(spark.createDataFrame([(0.0,)], "x double"), "skew.boxcox", "x")


def test_yeojohnson(spark):
    generator = random.Random(5)
    values = [generator.gauss(0, 1) ** 3 for _ in range(600)]
    df = spark.createDataFrame([*enumerate(values), (-1, None)], "i long, x double")

    def bend(x, p):
        up = np.log1p(np.abs(x)) if abs(p) < 1e-9 else ((np.abs(x) + 1) ** p - 1) / p
        q = 2 - p
        down = np.log1p(np.abs(x)) if abs(q) < 1e-9 else ((np.abs(x) + 1) ** q - 1) / q
        return np.where(x >= 0, up, -down)

    power = power_by_search(values, bend, lambda x: np.sign(x) * np.log1p(np.abs(x)))
    want = bend(np.array(values), power)
    want = (want - want.mean()) / want.std()
    found = column(apply_operation(df, "skew.yeojohnson", "x"), "x", "i")
    assert found[0] is None and found[1:] == pytest.approx(list(want), abs=1e-4)


def test_skew_is_reported(spark):
    df = spark.createDataFrame([(i * i,) for i in range(1, 21)], "amount long")
    change = skew_change(df, apply_operation(df, "skew.log_transform", "amount"), "amount").first()
    assert change["skewness_before"] > 0 > change["skewness_after"]
    with pytest.raises(OperationError):
        apply_operation(spark.createDataFrame([(-1.0,)], "x double"), "skew.sqrt_transform", "x")


@pytest.mark.parametrize(
    "word,want",
    [
        ("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("cats", "cat"), ("feed", "feed"),
        ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"),
        ("conflated", "conflat"), ("troubled", "troubl"), ("sized", "size"), ("hopping", "hop"),
        ("falling", "fall"), ("hissing", "hiss"), ("fizzed", "fizz"), ("filing", "file"), ("happy", "happi"),
        ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("rational", "ration"),
        ("valenci", "valenc"), ("digitizer", "digit"), ("radically", "radic"), ("vietnamization", "vietnam"),
        ("operator", "oper"), ("hopefulness", "hope"), ("formaliti", "formal"), ("sensibiliti", "sensibl"),
        ("triplicate", "triplic"), ("electrical", "electr"), ("goodness", "good"), ("revival", "reviv"),
        ("adoption", "adopt"), ("effective", "effect"), ("probate", "probat"), ("cease", "ceas"),
        ("controll", "control"), ("roll", "roll"), ("Dying", "die"), ("is", "is"), ("geologi", "geolog"),
    ],
)
def test_stems(word, want):
    assert stem(word.lower()) == want


def test_tokens(spark):
    text = "He said, \"don't stop\". It cost $3.50 (tax incl.)! We cannot go... they'll see."
    found = spark.createDataFrame([(text,)], "t string").select(tokenize(F.col("t")).alias("t")).first()["t"]
    assert found == [
        "He", "said", ",", "``", "do", "n't", "stop", "''", ".", "It", "cost", "$", "3.50", "(", "tax", "incl.", ")", "!",
        "We", "can", "not", "go", "...", "they", "'ll", "see", ".",
    ]


def test_text_rules(spark):
    df = spark.createDataFrame([("  The  QUICK\tfox, 42 ٣! ",), (None,)], "t string")
    run = lambda key, **p: column(apply_operation(df, f"text.{key}", "t", **p), "t")
    assert run("remove_extra_spaces") == ["The QUICK fox, 42 ٣!", ""]
    assert run("remove_numbers") == ["  The  QUICK\tfox,  ! ", ""]
    assert run("remove_punctuation") == ["  The  QUICK\tfox 42 ٣ ", ""]
    assert run("remove_stopwords") == ["QUICK fox, 42 ٣!", ""]
    assert run("stem") == ["the quick fox, 42 ٣!", ""]
    assert run("lemmatize", lemmas={"fox,": "wolf"}) == ["The QUICK wolf 42 ٣!", ""]
    assert run("tokenize")[1] == []
    with pytest.raises(OperationError):
        run("lemmatize")


def test_lemma_paths_agree(spark):
    texts = [("a hot text",)] * 40 + [("mice ran fast",), ("the geese",), (None,), ("  mice   mice ",)]
    df = spark.createDataFrame(texts, "t string").withColumn("i", F.monotonically_increasing_id())
    lemmas = {"mice": "mouse", "geese": "goose", "hot": "warm"}
    found = [
        column(apply_operation(df, "text.lemmatize", "t", lemmas=lemmas, lemma_rows=n), "t", "i") for n in (100, 1)
    ]
    assert found[0] == found[1] and found[0][0] == "a warm text" and found[0][-1] == "mouse mouse"


def test_vectors(spark):
    df = spark.createDataFrame([("apple apple pear a",), ("pear plum",), (None,)], "t string")
    bag = apply_operation(df, "text.bow", "t", max_features=2)
    assert bag.columns == ["t_bow_apple", "t_bow_pear"]
    assert [tuple(r) for r in bag.collect()] == [(2, 1), (0, 1), (0, 0)]
    weights = apply_operation(df, "text.tfidf", "t", max_features=2).collect()
    rare, common = math.log(4 / 2) + 1, math.log(4 / 3) + 1
    size = math.hypot(2 * rare, common)
    assert tuple(weights[0]) == pytest.approx((2 * rare / size, common / size))
    assert tuple(weights[2]) == (0.0, 0.0)


def test_chain_learns_together(spark):
    """Statistics of untouched columns come from one scan; touched ones are learned afresh."""
    df = spark.createDataFrame([(1.0, 10.0, "a"), (None, 20.0, "b"), (3.0, None, "b")], "x double, y double, k string")
    steps = [
        OperationSpec("missing_values.mean", "x"),
        OperationSpec("missing_values.mean", "y"),
        OperationSpec("scaling.minmax", "x"),
        OperationSpec("encoding.one_hot", "k"),
        OperationSpec("type_conversion.to_integer", "k_a"),
        OperationSpec("missing_values.drop_columns", "y"),
    ]
    result = run_chain(df, steps)
    assert result.dataframe.columns == ["x", "k_a", "k_b"]
    assert sorted(column(result.dataframe, "x")) == [0.0, 0.5, 1.0]
    assert result.metrics(spark).count() == 6
    with pytest.raises(OperationError):
        run_chain(df, [OperationSpec("missing_values.drop_columns", "y"), OperationSpec("scaling.minmax", "y")])


def test_accounts_are_counted_while_the_chain_runs(spark):
    """Every row of the input is read once, however many steps there are."""
    read = spark.sparkContext.accumulator(0)

    def once(row):
        read.add(1)
        return row

    rows = [(float(i % 50), " a " if i % 3 else None, "bad" if i % 5 == 0 else str(i)) for i in range(200)]
    df = spark.sparkContext.parallelize(rows, 3).map(once).toDF("x double, t string, n string")
    steps = [
        OperationSpec("type_conversion.to_float", "n"), OperationSpec("missing_values.constant", "t", {"value": "none"}),
        OperationSpec("text.remove_extra_spaces", "t"), OperationSpec("missing_values.drop_rows", "n"),
        OperationSpec("duplicates.keep_unique"),
    ]
    watch = watch_chain(df, steps)
    assert read.value == 0 and len(watch.dataframe.collect()) == 160
    found = watch.accounts()
    assert read.value == 200 and watch.rows == 160
    assert [(a[0], a[3], a[5]) for a in found] == [(1, 200, 40), (2, 67, None), (3, 133, None), (4, 40, None), (5, 0, None)]
    lazy = watch.result.metrics(spark).orderBy("step").collect()
    assert [tuple(r) for r in lazy] == [a[:5] for a in found]


def test_accounts_of_skipped_steps_are_counted_by_scans(spark, monkeypatch):
    """Without an action nothing is observed."""
    monkeypatch.setattr(cleaning, "_OBSERVED_WITHIN", 0.5)
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "x double")
    watch = watch_chain(df, [OperationSpec("missing_values.mean", "x"), OperationSpec("scaling.minmax", "x")])
    assert [a[3] for a in watch.accounts()] == [r["affected_row_count"] for r in watch.result.metrics(spark).orderBy("step").collect()]


def test_preview_leaves_the_table_alone(spark):
    df = spark.createDataFrame([(1.0,), (None,), (1.0,)], "x double")
    found = preview_chain(df, [OperationSpec("missing_values.drop_rows", "x"), OperationSpec("duplicates.remove")])
    assert found.before.first()["row_count"] == 3 and found.after.first()["row_count"] == 1
    assert [r["affected_row_count"] for r in found.steps.orderBy("step").collect()] == [1, 1]
    assert df.count() == 3 and found.sample_after.count() == 1


def test_lemmatize_needs_no_python_and_no_repeated_dictionary(spark, monkeypatch):
    from sievework.operators.cleaning import text as text_module

    generator = random.Random(4)
    known = [f"w{i}" for i in range(60)]
    texts = [" ".join(generator.choice(known[: 1 + i % 60]) for _ in range(i % 40)) for i in range(120)] + [None] + ["w1 w2"] * 30
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    table = {w: f"l{w}" for w in known if w != "w2"}
    lemmas = spark.createDataFrame([r for w, l in table.items() for r in ((w, l + "~"), (w, l))], "word string, lemma string")
    want = [" ".join(table.get(w, w) for w in (t or "").split()) for t in texts]
    monkeypatch.setattr(text_module, "_FREQUENT_WORDS", 7)
    for rows in (500, 0):
        monkeypatch.setattr(text_module, "_BROADCAST_ROWS", rows)
        done = text_module.lemmatize(df, "t", lemmas, rows)
        assert [r["t"] for r in done.orderBy("i").collect()] == want
        assert "Python" not in done._jdf.queryExecution().executedPlan().toString()
