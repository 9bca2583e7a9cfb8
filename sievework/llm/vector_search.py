"""Nearest vectors by probed lists, abandoning candidates on partial distances.

Vectors are dealt to lists by the nearest of some centroids.  A query probes the
lists whose centroids are nearest.  Within a list vectors are rotated by a fixed
random rotation, so that the first columns say something about the whole distance;
columns are read in blocks, and after each block a candidate is abandoned if its
partial distance, scaled up, exceeds the query's k-th nearest so far by more than
chance explains (a test with error ``epsilon``).  Survivors are measured exactly, in
double precision, on the original vectors.

There are as many lists as the root of the number of rows, so lists grow with the root too.
Centroids and the number of probed lists are fitted on a sample, the vectors with the
smallest hashes: ``sample`` or 16 a list, at most ``fit_bytes`` of doubles.  So many lists are
probed that at least ``coverage`` of the sample's own nearest neighbours lie in them.  All
rows are indexed.  Lists and queries are cut into units of at most about ``unit``
candidates and ``query_unit`` queries, so a hot list is many tasks.  A query that finds fewer
than ``k`` in its lists is sent to all lists.

Defined cases: vectors that are missing, zero, or hold missing or non-finite
components take no part, nor do vectors of another length than most (no distance joins
them).  Every other row is a candidate, also one that repeats an id or has none; only a
query's own row is not its neighbour.  Rows without an id are no queries; rows that repeat a
query's id are queries each.  With fewer candidates than ``k`` all are returned; ties of
distance go to the smaller id, a missing one last.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sievework.session import materialize


@dataclass(frozen=True)
class SearchSettings:
    k: int = 10
    sample: int = 8192
    coverage: float = 0.97
    #: Of doubles that the fit may hold: 16,384 lists of 128 columns. Lists grow faster than the root beyond the square of that.
    fit_bytes: int = 256 << 20
    columns: int = 16
    epsilon: float = 2.1
    unit: int = 4096
    query_unit: int = 512


def usable_vectors(rows: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """``vec_id, embedding`` of the rows that take part."""
    x = F.col("embedding")
    infinite = float("inf")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (v < infinite) & (v > -infinite)) & F.exists(x, lambda v: v != 0)
    good = rows.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("embedding"))
    good = good.filter(x.isNotNull() & fine)
    lengths = good.groupBy(F.size(x).alias("length")).count().orderBy(F.desc("count"), "length").first()
    if lengths is None:
        return good
    return good.filter(F.size(x) == lengths["length"])


@dataclass
class ListIndex:
    centroids: np.ndarray
    rotation: np.ndarray
    probes: int

    def nearest_lists(self, vectors: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` nearest lists of each vector, nearest first, for few vectors at a time."""
        weight, out = (self.centroids**2).sum(axis=1)[None, :], [np.zeros((0, n), np.int64)]
        step = max(1, (1 << 22) // len(self.centroids))
        for low in range(0, len(vectors), step):
            apart = weight - 2 * vectors[low : low + step] @ self.centroids.T
            out.append(apart.argmin(axis=1)[:, None] if n == 1 else np.argsort(apart, axis=1, kind="stable")[:, :n])
        return np.concatenate(out)


def sample_size(n: int, width: int, s: SearchSettings) -> tuple[int, int]:
    """Lists for ``n`` rows, and the vectors to fit them on."""
    most = max(16, s.fit_bytes // (8 * width))
    lists = max(1, min(math.isqrt(n), most // 16))
    return lists, min(most, max(s.sample, 16 * lists))


def fit_index(sample: np.ndarray, n: int, s: SearchSettings) -> ListIndex:
    """Centroids by k-means on the sample, a random rotation, and the number of lists to probe."""
    rng = np.random.default_rng(11)
    rotation = np.linalg.qr(rng.standard_normal((sample.shape[1],) * 2))[0]
    lists = max(1, min(sample_size(n, sample.shape[1], s)[0], len(sample) // 16))
    index = ListIndex(sample[rng.choice(len(sample), lists, replace=False)].copy(), rotation, lists)
    for _ in range(8):
        own = index.nearest_lists(sample, 1)[:, 0]
        sums = np.zeros_like(index.centroids)
        np.add.at(sums, own, sample)
        count = np.bincount(own, minlength=lists)
        index.centroids[count > 0] = sums[count > 0] / count[count > 0, None]
    own = index.nearest_lists(sample, 1)[:, 0]
    asked, near = sample[:256], []
    weight = (sample**2).sum(axis=1)
    for i, query in enumerate(asked):
        apart = weight - 2 * sample @ query
        apart[i] = np.inf
        near.append(np.argsort(apart)[: s.k])
    near = np.array(near)
    place = np.argsort(index.nearest_lists(asked, lists), axis=1)  # of each list in the query's order
    needed = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
    index.probes = int(needed[min(len(needed) - 1, int(s.coverage * len(needed)))]) + 1 if len(needed) else lists
    return index


def scan(queries: np.ndarray, own: np.ndarray, rows: np.ndarray, keys: np.ndarray, row_ids: np.ndarray, rotation: np.ndarray, s: SearchSettings):
    """For each query its k nearest of ``rows``, but for that of its own key, as arrays (query index, row index, distance)."""
    rq, rc = queries @ rotation, rows @ rotation
    width, n, m = rows.shape[1], len(rows), len(queries)
    # The first candidates are measured whole; they give each query a distance to beat.
    lead = min(n, 8 * s.k)
    first = ((queries[:, None, :] - rows[None, :lead, :]) ** 2).sum(axis=2)
    first[own[:, None] == keys[None, :lead]] = np.inf
    worst = np.partition(first, min(s.k, lead) - 1, axis=1)[:, s.k - 1] if lead >= s.k else np.full(m, np.inf)
    alive = np.ones((m, n), bool)
    partial = np.zeros((m, n))
    for low in range(0, width, s.columns):
        high = min(width, low + s.columns)
        live_q, live_c = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
        if not len(live_q) or not len(live_c):
            break
        a, b = rq[live_q, low:high], rc[live_c, low:high]
        step = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * a @ b.T
        cell = np.ix_(live_q, live_c)
        partial[cell] += np.maximum(step, 0)
        slack = (1 + s.epsilon / math.sqrt(high)) ** 2 if high < width else 1 + 1e-9
        alive[cell] &= partial[cell] * (width / high) <= worst[live_q, None] * slack + 1e-12
    out_q, out_c = np.nonzero(alive & (own[:, None] != keys[None, :]))
    exact = np.sqrt(((queries[out_q] - rows[out_c]) ** 2).sum(axis=1))
    order = np.lexsort((row_ids[out_c], exact, out_q))
    out_q, out_c, exact = out_q[order], out_c[order], exact[order]
    start = np.searchsorted(out_q, out_q)
    keep = np.arange(len(out_q)) - start < s.k
    return out_q[keep], out_c[keep], exact[keep]


def _lists(rows: DataFrame, index: ListIndex, probes: int) -> DataFrame:
    """``row, vec_id, embedding, list``: a row for each of the nearest ``probes`` lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 2048):
                part = batch.slice(low, 2048)
                flat = part.column("embedding").flatten().to_numpy().reshape(part.num_rows, -1)
                lists = index.nearest_lists(flat, probes)
                for k in range(lists.shape[1]):
                    columns = [part.column(c) for c in ("row", "vec_id", "embedding")] + [pa.array(lists[:, k].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, ["row", "vec_id", "embedding", "list"])

    return rows.select("row", "vec_id", "embedding").mapInArrow(run, "row long, vec_id long, embedding array<double>, list int")


def _nearest(listed: DataFrame, asked: DataFrame, index: ListIndex, s: SearchSettings) -> DataFrame:
    """``row, query_id, rank, vec_id, score``: each asked row's nearest within the lists it is sent to."""
    held, put = (x.groupBy("list").agg(F.count(F.lit(1)).alias(name)) for x, name in ((listed, "held"), (asked, "put")))
    # One row per list; there are at most as many as ``sample_size`` says.
    sizes = materialize(held.join(put, "list").withColumns({"cuts": F.ceil(F.col("held") / s.unit), "query_cuts": F.ceil(F.col("put") / s.query_unit)}).select("list", "cuts", "query_cuts"), "list-sizes")

    def dealt(rows: DataFrame, own: str, other: str, cut: str, every: str) -> DataFrame:
        """Each row in one cut of its own side and in all cuts of the other."""
        sized = rows.join(F.broadcast(sizes), "list").withColumn(cut, F.pmod(F.xxhash64("row"), F.col(own)))
        spread = sized.withColumn(every, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
        return spread.select(F.xxhash64("list", "cut", "query_cut").alias("unit"), "row", "vec_id", "embedding")

    c, q = dealt(listed, "cuts", "query_cuts", "cut", "query_cut"), dealt(asked, "query_cuts", "cuts", "query_cut", "cut")

    def run(_: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"row": [], "query_id": [], "vec_id": [], "score": []})
        ids = right["vec_id"].astype("Int64")
        order = ids.fillna(np.iinfo(np.int64).max).to_numpy(np.int64)
        asks, finds, score = scan(np.stack(left["embedding"]), left["row"].to_numpy(), np.stack(right["embedding"]), right["row"].to_numpy(), order, index.rotation, s)
        return pd.DataFrame({"row": left["row"].to_numpy()[asks], "query_id": left["vec_id"].to_numpy()[asks], "vec_id": ids.iloc[finds].array, "score": score})

    near = q.groupBy("unit").cogroup(c.groupBy("unit")).applyInPandas(run, "row long, query_id long, vec_id long, score double")
    # A limit on a rank per query: each task keeps k rows a query before anything is shuffled.
    nearest = Window.partitionBy("row").orderBy("score", F.col("vec_id").asc_nulls_last())
    return near.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= s.k).select("row", "query_id", "rank", "vec_id", "score")


def search(rows: DataFrame, is_query: Column, vec_id: str = "vec_id", embedding: str = "embedding", settings: SearchSettings = SearchSettings()) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the rows that ``is_query`` (a condition on ``vec_id``) marks, against all rows."""
    s, spark = settings, rows.sparkSession
    # The key of a row is written with it, so a repeated task cannot deal keys anew.
    good = materialize(usable_vectors(rows, vec_id, embedding).withColumn("row", F.monotonically_increasing_id()), "vectors")
    n = good.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    _, most = sample_size(n, len(good.first()["embedding"]), s)
    picked = good.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(most).select("embedding").toPandas()["embedding"]
    index = fit_index(np.stack(picked.to_numpy()).astype(float), n, s)
    queries = good.filter(is_query)
    listed = materialize(_lists(good, index, 1), "lists")
    asked = materialize(_lists(queries, index, index.probes), "probes")
    near = _nearest(listed, asked, index, s)
    lists = len(index.centroids)
    if index.probes < lists:
        near = materialize(near, "near")
        enough = near.filter(F.col("rank") == s.k).select("row")
        short = queries.join(enough, "row", "left_anti")
        if not short.isEmpty():
            everywhere = _nearest(listed, materialize(_lists(short, index, lists), "probes"), index, s)
            near = near.join(enough, "row", "left_semi").unionByName(everywhere)
    return near.select("query_id", "rank", "vec_id", "score")
