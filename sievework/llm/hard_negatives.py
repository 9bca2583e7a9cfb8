"""Hard negatives by a vertical scan with shrinking candidate bitmaps (BOND).

Vectors are held as columns: a block is some thousand rows, dimension by dimension, with
the least and the largest value of each dimension.  For an anchor a block's columns are
read in the order of the anchor's descending magnitudes.  After every few columns the
partial inner product plus the least and the most that the remaining columns can
contribute bounds each candidate's score from both sides, and the bitmap of candidates
shrinks to those that may still be in the answer.  What is left after the last column has its
exact score.

Two passes.  The first finds each anchor's positives: an anchor meets the blocks of its
label only, and a candidate goes when ``positives`` others are surely better.  The
second meets every block of other labels; each positive opens a window of scores, and a
candidate goes when no window can hold it any more, or when ``negatives`` others are surely
inside the window and surely better.  All blocks are read for all anchors, so the result
is exact.

Blocks and packs of anchors are bounded by the number of values they hold, whatever the labels'
sizes; each pair of a block and a pack is a unit of work of its own, so a hot label is
many units.  Each unit hands on at most ``positives`` or ``negatives`` rows an anchor or window.

Defined cases: rows without a label, without a vector or with missing or non-finite
components take no part, nor do those whose largest scaled component m has
m * m * length >= 2**62 (products would not fit a long); vectors meet vectors of their own
length only; anchors are never their own candidates, but rows that repeat an id are rows
of their own; ties go to the smaller id (missing ids last), then to an arbitrary one of equal
rows; a window whose least score is above its largest (negative positives) holds nothing; anchors without a
positive return nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from sievework.llm.tables import given_id, known_id
from sievework.session import materialize


@dataclass(frozen=True)
class NegativeSettings:
    positives: int = 5
    negatives: int = 10
    least_percent: int = 30
    most_percent: int = 90
    scale: int = 256
    #: Values of a block of rows, and of a pack of anchors.
    block: int = 1 << 19
    pack: int = 1 << 17
    #: Columns read between two looks at the bitmap.
    step: int = 8


def _scaled(rows: DataFrame, vec_id: str, embedding: str, label: Column, anchor: Column, s: NegativeSettings) -> DataFrame:
    x, infinite = F.col("x"), float("inf")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (v < infinite) & (v > -infinite))
    largest = F.coalesce(F.array_max(F.transform(x, F.abs)), F.lit(0.0)) * s.scale + 1
    picked = rows.select(
        F.monotonically_increasing_id().alias("row"), known_id(vec_id).alias("id"), label.cast("long").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(f"`{embedding}`").cast("array<double>").alias("x"),
    )
    picked = picked.filter(F.col("label").isNotNull() & x.isNotNull()).filter(fine).filter(largest * largest * F.size(x) < float(1 << 62))
    return picked.select("row", "id", "label", "anchor", F.transform(x, lambda v: F.floor(v * s.scale).cast("int")).alias("v"), F.size(x).alias("width"))


def _cells(values: int) -> Column:
    """How many rows of the width make up ``values`` values."""
    return F.greatest(F.lit(1), F.floor(F.lit(values) / F.greatest(F.col("width"), F.lit(1))))


def _dealt(rows: DataFrame, s: NegativeSettings) -> DataFrame:
    """With ``bucket, slot`` (a block) and the numbers of blocks and packs of the bucket and of the width."""
    per_width = rows.groupBy("width").agg(F.count("*").alias("_rows"))
    buckets = per_width.select("width", F.ceil(F.col("_rows") / _cells(s.block)).alias("buckets"))
    hashed = rows.join(buckets, "width").withColumn("bucket", F.pmod(F.xxhash64("label"), F.col("buckets"))).drop("buckets")
    sizes = hashed.groupBy("width", "bucket").agg(F.count("*").alias("_rows"), F.count_if("anchor").alias("_anchors"))
    sizes = sizes.select(
        "width", "bucket", F.ceil(F.col("_rows") / _cells(s.block)).alias("blocks"), F.ceil(F.col("_anchors") / _cells(s.pack)).alias("packs"), "_anchors"
    )
    sizes = materialize(sizes, "negatives-sizes")
    widths = sizes.groupBy("width").agg(F.sum("blocks").alias("all_blocks"), F.ceil(F.sum("_anchors") / _cells(s.pack)).alias("all_packs"))
    sizes = sizes.drop("_anchors").join(widths, "width")
    return hashed.join(sizes, ["width", "bucket"]).withColumn("slot", F.pmod(F.xxhash64("row"), F.col("blocks")))


def _every(count: str) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))


def _packed(group: pd.DataFrame, columns: list[str], by_column: bool) -> dict:
    vectors = np.stack([np.asarray(v, np.int32) for v in group["v"]])
    vectors = np.ascontiguousarray(vectors.T) if by_column else vectors
    return {c: group[c].to_numpy().astype(np.int64).tobytes() for c in columns} | {"v": vectors.tobytes()}


_SIZES = ["blocks", "packs", "all_blocks", "all_packs"]


def _blocks(dealt: DataFrame) -> DataFrame:
    """A row per block: its rows' ids and labels, and their vectors dimension by dimension."""
    keys = ["width", "bucket", "slot"]

    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        fixed = dict(zip(keys, key)) | {c: group[c].iloc[0] for c in _SIZES}
        return pd.DataFrame([fixed | _packed(group, ["row", "id", "label"], True)])

    spec = "width int, bucket long, slot long, blocks long, packs long, all_blocks long, all_packs long, row binary, id binary, label binary, v binary"
    return dealt.select(*keys, *_SIZES, "row", "id", "label", "v").groupBy(*keys).applyInPandas(pack, spec)


def _packs(anchors: DataFrame, keys: list[str], packs: str, blocks: str, scores: list[str]) -> DataFrame:
    """A row per pack of anchors; ``salts`` is the number of blocks that it meets."""
    keys = [*keys, "pack"]

    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        fixed = dict(zip(keys, key)) | {"salts": group["salts"].iloc[0]}
        return pd.DataFrame([fixed | {f"a_{k}": v for k, v in _packed(group, ["row", "label", *scores], False).items()}])

    placed = anchors.withColumn("pack", F.pmod(F.xxhash64("row"), F.col(packs))).withColumn("salts", F.col(blocks))
    spec = ", ".join(f"{k} {'int' if k == 'width' else 'long'}" for k in keys) + ", salts long, "
    spec += ", ".join(f"a_{c} binary" for c in ("row", "label", *scores, "v"))
    return placed.select(*keys, "salts", "row", "label", *scores, "v").groupBy(*keys).applyInPandas(pack, spec)


class Columns:
    """A block, and the bounds of what its columns contribute."""

    def __init__(self, unit) -> None:
        self.row, self.id, self.label = (np.frombuffer(unit[c], np.int64) for c in ("row", "id", "label"))
        self.v = np.frombuffer(unit["v"], np.int32).reshape(unit["width"], len(self.row))
        self.low, self.high = self.v.min(axis=1, initial=0), self.v.max(axis=1, initial=0)
        self._as: dict = {}

    def kind(self, anchor: np.ndarray) -> type:
        """Doubles where all sums are exact in them."""
        largest = max(-int(self.low.min(initial=0)), int(self.high.max(initial=0)))
        return np.float64 if int(np.abs(anchor.astype(np.int64)).sum()) * largest < 1 << 52 else np.int64

    def scan(self, anchor: np.ndarray, alive: np.ndarray, step: int, shrink) -> tuple[np.ndarray, np.ndarray]:
        """The candidates that ``shrink`` leaves and their exact scores.

        ``shrink(least, most)`` says from bounds of the scores which candidates may still be in the answer.
        """
        kind = self.kind(anchor)
        v = self._as.setdefault(kind, self.v.astype(kind))
        a = anchor.astype(kind)
        order = np.argsort(-np.abs(a), kind="stable")
        ends = np.stack([a * self.low.astype(kind), a * self.high.astype(kind)])[:, order]
        least, most = (np.concatenate([np.cumsum(e[::-1])[::-1], [0]]) for e in (ends.min(axis=0), ends.max(axis=0)))
        partial = np.zeros(len(alive), kind)
        for start in range(0, len(a), step):
            dims = order[start : start + step]
            part = v[dims] if len(alive) == v.shape[1] else v[dims[:, None], alive[None, :]]
            partial = partial + a[dims] @ part
            done = min(start + step, len(a))
            keep = shrink(partial + least[done], partial + most[done])
            if not keep.all():
                alive, partial = alive[keep], partial[keep]
            if not len(alive):
                break
        return alive, partial.astype(np.int64)


def _kth(values: np.ndarray, k: int):
    """The k-th largest, or None with fewer."""
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else None


def _first(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((rows, ids, -scores))[:k]


def best(block: Columns, anchor: np.ndarray, of: np.ndarray, k: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and scores of the ``k`` best of the candidates ``of``, best first."""

    def shrink(least, most):
        bar = _kth(least, k)
        return np.ones(len(least), bool) if bar is None else most >= bar

    alive, scores = block.scan(anchor, of, step, shrink)
    order = _first(scores, block.id[alive], block.row[alive], k)
    return alive[order], scores[order]


def in_windows(block: Columns, anchor: np.ndarray, of: np.ndarray, windows: list[tuple[int, int]], k: int, step: int):
    """For each window (least, most) positions and scores of its ``k`` best candidates, best first."""

    def shrink(least, most):
        keep = np.zeros(len(least), bool)
        for low, high in windows:
            bar = _kth(least[(least >= low) & (most <= high)], k)
            keep |= (most >= (low if bar is None else bar)) & (least <= high)
        return keep

    alive, scores = block.scan(anchor, of, step, shrink)
    for low, high in windows:
        inside = np.flatnonzero((scores >= low) & (scores <= high))
        order = inside[_first(scores[inside], block.id[alive[inside]], block.row[alive[inside]], k)]
        yield alive[order], scores[order]


def window_of(score: int, s: NegativeSettings) -> tuple[int, int]:
    """The least and the largest score with ``least% * positive <= 100 * negative <= most% * positive``."""
    return -((-s.least_percent * score) // 100), (s.most_percent * score) // 100


_NO_SCORE = -(1 << 63)
_FOUND = "anchor long, place int, candidate long, id long, score long"


def _meet(blocks: DataFrame, packs: DataFrame, keys: list[str], count: str, salt: Column, work) -> DataFrame:
    """``work(block, anchors)`` for each block and pack of equal keys; every pair is a unit of its own."""
    left = blocks.filter(F.col(count) > 0).withColumn("pack", _every(count)).withColumn("salt", salt)
    right = packs.withColumn("salt", _every("salts")).drop("salts")
    unit = [*keys, "pack", "salt"]

    def run(units: pd.DataFrame) -> pd.DataFrame:
        found = [line for unit in units.to_dict("records") for line in work(unit)]
        columns = [np.concatenate([line[i] for line in found]) if found else np.empty(0, np.int64) for i in range(5)]
        return pd.DataFrame(dict(zip(("anchor", "place", "candidate", "id", "score"), columns)))

    read = [*unit, "row", "id", "label", "v", *[c for c in packs.columns if c.startswith("a_")]]
    read = list(dict.fromkeys(["width", *read]))
    return left.join(right, unit).select(*read).groupBy(*unit).applyInPandas(run, _FOUND)


def hard_negatives(
    rows: DataFrame,
    label: Column,
    is_anchor: Column,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    settings: NegativeSettings = NegativeSettings(),
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows that ``is_anchor`` marks.

    ``label`` is a whole number per row; both conditions are on the columns of ``rows``.
    """
    s = settings
    scaled = materialize(_scaled(rows, vec_id, embedding, label, is_anchor, s), "negatives-rows")
    dealt = _dealt(scaled, s)
    blocks = materialize(_blocks(dealt), "negatives-blocks")
    anchors = materialize(dealt.filter("anchor"), "negatives-anchors")

    def vectors(unit: dict, names: list[str]):
        packed = [np.frombuffer(unit[f"a_{n}"], np.int64) for n in names]
        return zip(np.frombuffer(unit["a_v"], np.int32).reshape(len(packed[0]), unit["width"]), *packed)

    def lines(anchor: int, place: int, block: Columns, at: np.ndarray, scores: np.ndarray) -> tuple:
        n = len(at)
        return np.full(n, anchor), np.full(n, place), block.row[at], block.id[at], scores

    def positives(unit: dict):
        block = Columns(unit)
        for v, row, own in vectors(unit, ["row", "label"]):
            of = np.flatnonzero((block.label == own) & (block.row != row))
            yield lines(row, 0, block, *best(block, v, of, s.positives, s.step))

    places = [f"score{i}" for i in range(s.positives)]

    def negatives(unit: dict):
        block = Columns(unit)
        for v, row, own, *scores in vectors(unit, ["row", "label", *places]):
            windows = [(i, *window_of(int(p), s)) for i, p in enumerate(scores) if p != _NO_SCORE]
            windows = [w for w in windows if w[1] <= w[2]]
            if windows:
                of = np.flatnonzero(block.label != own)
                for (i, *_), found in zip(windows, in_windows(block, v, of, [w[1:] for w in windows], s.negatives, s.step)):
                    yield lines(row, i, block, *found)

    def first(found: DataFrame, by: list[str], k: int) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc("score"), "id", "candidate")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    packs = _packs(anchors, ["width", "bucket"], "packs", "blocks", [])
    near = first(_meet(blocks, packs, ["width", "bucket"], "packs", F.col("slot"), positives), ["anchor"], s.positives)
    near = materialize(near.select("anchor", (F.col("rank") - 1).alias("place"), "id", "score"), "negatives-positives")

    per_place = [F.coalesce(F.max(F.when(F.col("place") == i, F.col("score"))), F.lit(_NO_SCORE)).alias(c) for i, c in enumerate(places)]
    scores = near.groupBy(F.col("anchor").alias("row")).agg(*per_place)
    asked = anchors.join(scores, "row")
    packs = _packs(asked, ["width"], "all_packs", "all_blocks", places)
    salt = F.pmod(F.xxhash64("bucket", "slot"), F.col("all_blocks"))
    hard = first(_meet(blocks, packs, ["width"], "all_packs", salt, negatives), ["anchor", "place"], s.negatives)
    hard = hard.select("anchor", "place", "rank", given_id("id").alias("negative_id"), F.col("score").alias("negative_score"))
    near = near.select("anchor", "place", given_id("id").alias("positive_id"), F.col("score").alias("positive_score"))
    ids = anchors.select(F.col("row").alias("anchor"), given_id("id").alias("anchor_id"))
    return hard.join(near, ["anchor", "place"]).join(ids, "anchor").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )
