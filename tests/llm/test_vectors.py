"""Hard negatives and near vectors against all pairs, with odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.llm.hard_negatives import Columns, NegativeSettings, best, hard_negatives, in_windows, window_of
from sievework.llm.near_vectors import NearSettings, fit_multi_index, near_vectors

SPEC = "vec_id long, embedding array<double>, label int, row int, cls string"


def odd_rows(first):
    nan, inf = float("nan"), float("inf")
    strange = [None, [], [0.0] * 6, [nan] + [1.0] * 5, [None] + [1.0] * 5, [inf] + [0.0] * 5, [1.0, 2.0], [1.0, 2.0], [-1.0, 0.5], [1e300] * 6, [1e-300] * 6]
    rows = [(first + i, v, i % 3) for i, v in enumerate(strange)]
    return rows + [(None, [1.0] * 6, 1), (None, [1.0] * 6, None), (first, [1.0] * 6, 2), (first, [1.0] * 6, 2)]


def made(n, seed, spread=0.05, width=6, hot=0.4):
    """Groups of near copies, exact copies, and one group that holds much of the rows."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 6, width))
    of = np.where(rng.random(n) < hot, 0, rng.integers(0, len(centres), n))
    vectors = centres[of] + spread * rng.standard_normal((n, width))
    vectors[rng.random(n) < 0.2] = centres[3]
    return [(i, [float(x) for x in v], int(rng.integers(0, 4)) if rng.random() < 0.9 else 0) for i, v in enumerate(vectors)]


def brute_negatives(rows):
    def usable(v):
        if v is None or not all(x is not None and math.isfinite(x) for x in v):
            return False
        largest = max(map(abs, v), default=0) * 256 + 1
        return largest * largest * len(v) < 2**62

    good = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if label is not None and usable(v)]
    out = []
    for a, (i, v, label) in enumerate(good):
        if i is None or i % 10:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), j is None, j or 0, other) for b, (j, w, other) in enumerate(good) if b != a and len(w) == len(v)]
        for p, unknown, j, _ in sorted(x for x in scored if x[3] == label)[:5]:
            p = -p
            hard = sorted(x for x in scored if x[3] != label and 30 * p <= -100 * x[0] <= 90 * p)[:10]
            out += [(i, None if unknown else j, r + 1, None if none else k, p, -s) for r, (s, none, k, _) in enumerate(hard)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("settings", [NegativeSettings(), NegativeSettings(block=6 * 16, pack=6 * 4, step=2)])
def test_hard_negatives(spark, settings):
    rows = made(400, 1, spread=0.6) + odd_rows(1000)
    table = spark.createDataFrame([(*r, 7, "x") for r in rows], SPEC)
    got = hard_negatives(table, F.col("label"), F.col("vec_id") % 10 == 0, settings=settings)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute_negatives(rows)
    assert len(want) > 500 and sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_hard_negatives_of_nothing(spark):
    table = spark.createDataFrame(odd_rows(1000), "vec_id long, embedding array<double>, label int")
    assert hard_negatives(table.limit(0), F.col("label"), F.lit(True)).count() == 0
    assert hard_negatives(table, F.lit(None), F.lit(True)).count() == 0
    assert hard_negatives(table, F.col("label"), F.lit(None).cast("boolean")).count() == 0


def test_bitmaps_shrink_before_the_last_column():
    rng = np.random.default_rng(3)
    v = (rng.standard_normal((64, 3000)) * (256 / np.arange(1, 65)[:, None])).astype(np.int32)
    ids = np.arange(3000)
    block = Columns({"row": ids.tobytes(), "id": ids.tobytes(), "label": (ids % 2).tobytes(), "v": np.ascontiguousarray(v).tobytes(), "width": 64})
    anchor = v[:, 5]
    scores = anchor.astype(np.int64) @ v.astype(np.int64)
    seen = []

    def watched(least, most):
        seen.append(len(least))
        return np.ones(len(least), bool) if len(least) < 5 else most >= np.sort(least)[-5]

    block.scan(anchor, ids, 8, watched)
    assert seen[0] == 3000 and seen[-1] < 600
    at, found = best(block, anchor, ids, 5, 8)
    assert found.tolist() == np.sort(scores)[::-1][:5].tolist()
    low, high = window_of(int(found[1]), NegativeSettings())
    [(at, inside)] = in_windows(block, anchor, ids, [(low, high)], 10, 8)
    assert inside.tolist() == np.sort(scores[(scores >= low) & (scores <= high)])[::-1][:10].tolist()
    big = Columns({"row": ids[:2].tobytes(), "id": ids[:2].tobytes(), "label": ids[:2].tobytes(), "v": np.full((2, 2), 2**30 - 1, np.int32).tobytes(), "width": 2})
    assert best(big, big.v[:, 0], ids[:2], 2, 8)[1].tolist() == [2 * (2**30 - 1) ** 2] * 2


def brute_near(rows, least=0.95):
    ids = [r[0] for r in rows]
    good = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, *_ in rows]
    unit = [np.array(v) / max(map(abs, v)) if ok else None for (_, v, *_), ok in zip(rows, good)]
    unit = [u / np.linalg.norm(u) if u is not None else None for u in unit]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = set()
    for i in range(len(rows)):
        for j in range(i):
            if good[i] and good[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least:
                links[i] += 1
                links[j] += 1
                pairs.add((i, j))
                root[find(i)] = find(j)
    reach = {}
    for i in range(len(rows)):
        reach.setdefault(find(i), []).append(ids[i])
    least_id = {r: min((x for x in v if x is not None), default=None) for r, v in reach.items()}
    out = [(ids[i], links[i], least_id[find(i)], ids[i] == least_id[find(i)]) for i in range(len(rows))]
    return sorted(out, key=repr), len(pairs)


@pytest.mark.parametrize("settings", [NearSettings(recall=1.0), NearSettings(recall=1.0, occupancy=4, block=16)])
def test_near_vectors(spark, settings):
    rows = made(700, 2, spread=0.12) + odd_rows(1000)
    table = spark.createDataFrame([(*r, 7, "x") for r in rows], SPEC)
    got = near_vectors(table, settings=settings)
    want, pairs = brute_near(rows)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"] and pairs > 20_000
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_near_vectors_of_nothing(spark):
    table = spark.createDataFrame([(1, None), (2, [0.0]), (None, [])], "vec_id long, embedding array<float>")
    assert near_vectors(table.limit(0)).count() == 0
    assert sorted(map(tuple, near_vectors(table).collect()), key=repr) == sorted([(1, 0, 1, True), (2, 0, 2, True), (None, 0, None, True)], key=repr)


def test_recall_of_the_fitted_slack():
    rng = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    rows = unit(rng.standard_normal((6000, 32)))
    aside = rng.standard_normal(rows.shape)
    aside = unit(aside - (aside * rows).sum(axis=1, keepdims=True) * rows)
    partner = 0.955 * rows + math.sqrt(1 - 0.955**2) * aside
    index = fit_multi_index(rows[:4000], 100_000, NearSettings())
    found = np.minimum(index.beyond(rows, index.home(partner)), index.beyond(partner, index.home(rows))) <= index.slack
    row, _ = index.visits(rows)
    assert found.mean() >= 0.97 and len(row) / len(rows) < 0.1 * len(index.left) ** 2
