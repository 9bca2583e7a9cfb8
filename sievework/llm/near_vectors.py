"""Near-duplicate vectors by an inverted multi-index.

Vectors are scaled to length one and cut into halves.  Each half has a codebook of its
own; a cell of the product grid is a pair of centroids, and a vector lives in the cell of its
two nearest ones.  A vector visits the cells in the order of their distance, which is the sum of the
distances to both centroids (the multi-sequence order), from its own cell as far as ``slack``
beyond it.  Visitors meet the inhabitants of a cell, and all their cosines are computed in double
precision.

The slack is fitted on a sample for the target recall: vectors of the sample get partners at exactly
the least cosine that links, in random directions, and together with all true links within the
sample the slack is taken that finds the share ``recall`` of the pairs, from either side.  Codebooks
are fitted on the rows with the smallest hashes; there are as many cells as ``occupancy`` vectors a cell
need, so codebooks grow with the square root of the number of vectors, and the sample with them (``per_centroid``
vectors a centroid, ``sample`` at least).  Every row is indexed and visits.

Equal vectors are one class with a count, so copies are compared once.  Inhabitants and visitors of a
crowded cell are cut into units of at most about ``block`` rows a side; a unit hands on a row per
class that has links (their number and one member of its component there), never pairs.  A pair whose classes visit
each other's cells is counted where the smaller class visits.

Defined cases: vectors that are missing, empty, zero, or hold missing or non-finite components link with
nothing; vectors link with vectors of their own length only; rows that repeat an id are rows of
their own; rows without an id count as the largest id and keep none (``kept`` says whether the
component has ids smaller than that); an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sievework.llm.tables import components, given_id, known_id
from sievework.session import materialize


@dataclass(frozen=True)
class NearSettings:
    cosine: float = 0.95
    recall: float = 0.99
    occupancy: int = 32
    sample: int = 8192
    per_centroid: int = 16
    #: Vectors of the sample that the slack is fitted with, and partners made for each.
    asked: int = 512
    partners: int = 8
    block: int = 1024


def _nearest(half: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances to the centroids, less the vectors' own squares."""
    return (book**2).sum(axis=1)[None, :] - 2 * half @ book.T


def _codebook(half: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    book = half[rng.choice(len(half), n, replace=False)].copy()
    for _ in range(6):
        own = np.concatenate([_nearest(half[i : i + 2048], book).argmin(axis=1) for i in range(0, len(half), 2048)])
        order = np.argsort(own, kind="stable")
        used, start = np.unique(own[order], return_index=True)
        book[used] = np.add.reduceat(half[order], start, axis=0) / np.diff([*start, len(half)])[:, None]
    return book


@dataclass
class MultiIndex:
    left: np.ndarray
    right: np.ndarray
    slack: float = 0.0

    def halves(self, vectors: np.ndarray) -> list[np.ndarray]:
        """Per half, how much farther than the nearest centroid each centroid is."""
        cut = self.left.shape[1]
        apart = [_nearest(vectors[:, :cut], self.left), _nearest(vectors[:, cut:], self.right)]
        return [a - a.min(axis=1, keepdims=True) for a in apart]

    def home(self, vectors: np.ndarray) -> np.ndarray:
        first, second = (a.argmin(axis=1) for a in self.halves(vectors))
        return first * len(self.right) + second

    def beyond(self, vectors: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """How much farther than its own cell each vector's given cell is."""
        first, second = self.halves(vectors)
        at = np.arange(len(vectors))
        return first[at, cells // len(self.right)] + second[at, cells % len(self.right)]

    def visits(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of vectors and the cells that they visit, each vector's nearest first.

        Only centroids within the slack of the nearest can be part of such a cell, so both
        sorted sequences are cut there and their sums compared.
        """
        sorted_, order = [], []
        for apart in self.halves(vectors):
            most = max(1, int((apart <= self.slack).sum(axis=1).max(initial=0)))
            by = np.argsort(apart, axis=1, kind="stable")[:, :most]
            order.append(by)
            sorted_.append(np.take_along_axis(apart, by, axis=1))
        row, cell, far = [], [], []
        for k in range(sorted_[0].shape[1]):
            total = sorted_[0][:, k, None] + sorted_[1]
            at, j = np.nonzero(total <= self.slack)
            row.append(at)
            cell.append(order[0][at, k] * len(self.right) + order[1][at, j])
            far.append(total[at, j])
        row, cell, far = (np.concatenate(x) for x in (row, cell, far))
        by = np.lexsort((cell, far, row))
        return row[by], cell[by]


def fit_multi_index(sample: np.ndarray, n: int, s: NearSettings) -> MultiIndex:
    """Codebooks for ``n`` vectors and the slack that finds the share ``s.recall`` of links."""
    rng = np.random.default_rng(23)
    cut, width = (sample.shape[1] + 1) // 2, sample.shape[1]
    centroids = max(1, min(math.ceil(math.sqrt(n / s.occupancy)), len(sample)))
    index = MultiIndex(_codebook(sample[:, :cut], centroids, rng), _codebook(sample[:, cut:], centroids, rng))
    asked = sample[rng.permutation(len(sample))[: s.asked]]
    near, partner = np.nonzero(asked @ sample.T >= s.cosine)
    pairs = [(asked[near], sample[partner])]
    if width > 1:
        for _ in range(s.partners):
            aside = rng.standard_normal(asked.shape)
            aside -= (aside * asked).sum(axis=1, keepdims=True) * asked
            aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-300)
            pairs.append((asked, s.cosine * asked + math.sqrt(1 - s.cosine**2) * aside))
    # Real links must not hide what made ones need, nor the other way round.
    index.slack = max(
        float(np.quantile(np.minimum(index.beyond(a, index.home(b)), index.beyond(b, index.home(a))), s.recall)) if len(a) else 0.0
        for a, b in (pairs[0], tuple(np.concatenate(x) for x in zip(*pairs[1:])) if width > 1 else pairs[0])
    ) + 1e-9
    return index


def _classes(rows: DataFrame) -> DataFrame:
    """``cls, n, first, v``: each different vector, scaled to length one."""
    x, infinite = F.col("x"), float("inf")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (v < infinite) & (v > -infinite)) & F.exists(x, lambda v: v != 0)
    good = rows.filter(x.isNotNull()).filter(fine)
    return good.groupBy("cls").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.first("x").alias("x"))


def _unit_length(batch: pa.RecordBatch, width: int) -> np.ndarray:
    flat = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, width)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)  # no square overflows or vanishes
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def _indexed(classes: DataFrame, index: MultiIndex, width: int) -> DataFrame:
    """``cls, n, v, home, cells``: each class with its cell and all cells that it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                v = _unit_length(part, width)
                row, cell = index.visits(v)
                ends = np.searchsorted(row, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("cls"), part.column("n"),
                        pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), width).cast(pa.list_(pa.float64())),
                        pa.array(index.home(v).astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(cell.astype(np.int64))),
                    ],
                    ["cls", "n", "v", "home", "cells"],
                )

    return classes.select("cls", "n", "x").mapInArrow(run, "cls string, n long, v array<double>, home long, cells array<long>")


def _forest(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """For links between nodes below ``n`` the smallest node reachable from each node."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _unit_links(visitors: pd.DataFrame, inhabitants: pd.DataFrame, cosine: float, cells: int) -> pd.DataFrame:
    """``cls, other, links`` of one unit."""
    nothing = pd.DataFrame({"cls": [], "other": [], "links": []}).astype({"cls": object, "other": object, "links": "int64"})
    if not len(visitors) or not len(inhabitants):
        return nothing
    a, b = np.stack(visitors["v"]), np.stack(inhabitants["v"])
    cls_a, cls_b = visitors["cls"].to_numpy(str), inhabitants["cls"].to_numpy(str)
    at, by = np.nonzero(a @ b.T >= cosine)
    keep = cls_a[at] != cls_b[by]
    at, by = at[keep], by[keep]
    # Who visits whose cell: an inhabitant's visits, looked up by the visitor's own cell.
    lists = inhabitants["cells"].to_numpy()
    visited = np.repeat(np.arange(len(lists)), [len(x) for x in lists]) * cells + np.concatenate(lists)
    both = np.isin(by * cells + visitors["home"].to_numpy()[at], visited)
    keep = ~both | (cls_a[at] < cls_b[by])
    at, by = at[keep], by[keep]
    if not len(at):
        return nothing
    links_a = np.bincount(at, inhabitants["n"].to_numpy()[by].astype(float), len(a))
    links_b = np.bincount(by, visitors["n"].to_numpy()[at].astype(float), len(b))
    cls, links = np.concatenate([cls_a, cls_b]), np.concatenate([links_a, links_b])
    # The same class may stand on both sides of a unit.
    names, node = np.unique(cls, return_inverse=True)
    root = _forest(node[: len(a)][at], node[len(a) :][by], len(names))
    total = np.bincount(node, links, len(names)).astype(np.int64)
    some = np.flatnonzero(total)
    names = names.astype(object)
    return pd.DataFrame({"cls": names[some], "other": names[root[some]], "links": total[some]}).astype({"cls": object, "other": object})


def _links(indexed: DataFrame, cells: int, s: NearSettings) -> DataFrame:
    """``cls, other, links``: per class and unit the copies it links with; ``other`` spans the links."""
    visits = indexed.select(F.explode("cells").alias("cell"), "cls", "n", "v", "home")
    living = indexed.select(F.col("home").alias("cell"), "cls", "n", "v", "cells")
    crowds = visits.groupBy("cell").agg(F.count("*").alias("_visitors")).join(
        living.groupBy("cell").agg(F.count("*").alias("_living")), "cell"
    ).filter(F.greatest("_visitors", "_living") > s.block)
    crowds = crowds.select("cell", F.ceil(F.col("_visitors") / s.block).alias("visitor_cuts"), F.ceil(F.col("_living") / s.block).alias("cuts"))
    # At most a row per ``block`` visits, so that Spark, knowing the written size, may broadcast it.
    crowds = materialize(crowds, "near-crowds")

    def cut(rows: DataFrame, own: str, other: str) -> DataFrame:
        one = F.lit(1).cast("long")
        joined = rows.join(crowds, "cell", "left").withColumns({c: F.coalesce(c, one) for c in ("visitor_cuts", "cuts")})
        place, opposite = F.pmod(F.xxhash64("cls"), F.col(own)), F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))
        dealt = joined.withColumn("_own", place).withColumn("_opposite", opposite)
        pair = ("_own", "_opposite") if own == "cuts" else ("_opposite", "_own")
        return dealt.select(F.col("cell"), *[F.col(c).alias(k) for c, k in zip(pair, ("cut", "visitor_cut"))], *[c for c in rows.columns if c != "cell"])

    keys = ["cell", "cut", "visitor_cut"]
    visitors, inhabitants = cut(visits, "visitor_cuts", "cuts"), cut(living, "cuts", "visitor_cuts")
    inhabitants = inhabitants.toDF(*inhabitants.columns)  # columns of its own, though both come from one table

    def run(_: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _unit_links(left, right, s.cosine, cells)

    found = visitors.groupBy(*keys).cogroup(inhabitants.groupBy(*keys)).applyInPandas(run, "cls string, other string, links long")
    return materialize(found, "near-links")


def near_vectors(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", settings: NearSettings = NearSettings()) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row: its links and the smallest id that links reach."""
    s = settings
    x = F.transform(F.col(f"`{embedding}`"), lambda v: v.cast("double") + 0.0)  # one zero
    every = rows.select(known_id(vec_id).alias("id"), x.alias("x"))
    every = every.withColumn("cls", F.concat(F.hex(F.xxhash64("x")), F.lit(":"), F.hex(F.xxhash64(F.lit(1), "x")), F.lit(":"), F.size("x")))
    every = materialize(every, "near-rows")
    classes = materialize(_classes(every), "near-classes")
    found = []
    # Lengths of vectors are few: at most as many as the longest has components.
    for size in classes.groupBy(F.size("x").alias("width")).count().orderBy("width").collect():
        width, n = size["width"], size["count"]
        own = classes.filter(F.size("x") == width)
        wanted = max(s.sample, s.per_centroid * math.ceil(math.sqrt(n / s.occupancy)))
        picked = own.orderBy(F.xxhash64("cls"), "cls").limit(wanted).select("x").toArrow()
        index = fit_multi_index(_unit_length(picked.combine_chunks().to_batches()[0], width), n, s)
        indexed = materialize(_indexed(own, index, width), "near-indexed")
        found.append(_links(indexed, len(index.left) * len(index.right), s))
    if not found:
        return every.select(
            given_id("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), given_id("id").alias("component_id"), F.lit(True).alias("kept")
        )
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    roots = components(links.select(F.col("cls").alias("a"), F.col("other").alias("b")).distinct())
    degrees = links.groupBy("cls").agg(F.sum("links").alias("links"))
    rooted = classes.select("cls", "n", "first").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "cls"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component"))
    judged = rooted.join(least, "root").join(degrees, "cls", "left").select(
        "cls", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), "component"
    )
    judged = materialize(judged, "near-judged")
    out = every.select("id", "cls").join(judged, "cls", "left").withColumn("component", F.coalesce("component", "id"))
    return out.select(
        given_id("id").alias("vec_id"), F.coalesce("links", F.lit(0).cast("long")).alias("n_links"),
        given_id("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"),
    )
