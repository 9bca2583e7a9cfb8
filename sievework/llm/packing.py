"""Pack tokenised documents into as few fixed-length sequences as possible.

1. Whole texts become token ids, an end id each; only documents longer than a
   sequence are cut, into full pieces and a rest.  Full pieces are sequences.
2. The other pieces are dealt at random to shards of about ``shard_pieces``; shards
   are packed independently by the linear grouping scheme:
   a) large pieces, from long to short, are cut into groups of equal number and
      rounded up to the longest of their group, so few sizes are left;
   b) the best mix of configurations (how many pieces of each size fit together) is a
      linear programme, solved by column generation: an integer knapsack prices new
      configurations until none helps;
   c) whole parts of the solution are filled with the actual, shorter pieces; rounding
      leaves some of them half empty, and those are undone.  How much room a kept one
      may have is tried at several values, the last of which undoes all;
   d) what is left and all small pieces go, from long to short, where they fit best.

Defined cases: a missing text is an empty one, which is the end id alone; missing ids
stay missing; repeated rows are packed each; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sievework.llm.bytesets import slices
from sievework.llm.token_ids import default_tokenizer, encoder
from sievework.session import materialize

#: Bytes of text encoded at a time: the more, the less often a word is looked up.
_SLICE = 1 << 22


@dataclass(frozen=True)
class PackSettings:
    tokenizer: str | None = None
    capacity: int = 4096
    end_id: int = 1
    #: Pieces of at least this part of a sequence are large.
    large: float = 1 / 8
    groups: int = 24
    #: Filled configurations with more of a sequence left than this are undone; the part that needs fewest sequences wins.
    spare: tuple[float, ...] = (1.0, 1 / 16, 1 / 64, 1 / 256, 0.0, -1.0)
    #: Sizes are also rounded up to multiples of this, which keeps the knapsack small.
    grain: int = 16
    shard_pieces: int = 16_384


def pieces(docs: DataFrame, doc_id: str, text: str, s: PackSettings, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece int, start long, length long, ids_crc32 long`` and, if asked for, ``ids array<int>``."""
    path, capacity, end = s.tokenizer or default_tokenizer(), s.capacity, np.array([s.end_id], "<u4")
    kind = docs.select(F.col(f"`{doc_id}`").alias("doc_id")).schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, own in enumerate(encode.ids_of(part.column("text"))):
                    own = np.concatenate([own, end])
                    for k, low in enumerate(range(0, len(own), capacity)):
                        cut = own[low : low + capacity]
                        row.append(i)
                        piece.append(k)
                        start.append(low)
                        length.append(len(cut))
                        crc.append(zlib.crc32(cut.tobytes()))
                        if with_ids:
                            ids.append(cut.astype(np.int32))
                columns = {
                    "doc_id": part.column("doc_id").take(pa.array(row, pa.int64())), "piece": pa.array(piece, pa.int32()),
                    "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    spec = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, spec)


def _knapsack(sizes: np.ndarray, worth: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most worth that fits into ``room`` when sizes may repeat, and how many of each."""
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        fits = sizes <= c
        value = np.where(fits, worth + best[np.where(fits, c - sizes, 0)], -1.0)
        i = int(value.argmax())
        if value[i] > best[c - 1] + 1e-12:
            best[c], pick[c] = value[i], i
        else:
            best[c] = best[c - 1]
    counts, c = np.zeros(len(sizes), np.int64), room
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            counts[pick[c]] += 1
            c -= sizes[pick[c]]
    return float(best[room]), counts


def configurations(sizes: np.ndarray, need: np.ndarray, room: int, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Configurations (columns) and how often each is used in the best fractional packing of ``need`` pieces.

    Column generation on the covering programme: duals of the basis price the
    sizes, a knapsack finds the best new configuration, the ratio test says which
    configuration it replaces.
    """
    basis = np.diag((room // sizes).astype(float))
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        use = inverse @ need
        value, column = _knapsack(sizes, np.maximum(inverse.sum(axis=0), 0), room)
        if value <= 1 + 1e-7:
            break
        change = inverse @ column
        ratio = np.where(change > 1e-9, np.maximum(use, 0) / np.where(change > 1e-9, change, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    return basis, np.maximum(np.linalg.inv(basis) @ need, 0)


def pack_lengths(lengths: np.ndarray, s: PackSettings) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each length, by the scheme above."""
    order = np.argsort(-lengths, kind="stable")
    n_large = int((lengths >= s.large * s.capacity).sum())
    filled: list[list[int]] = []
    if n_large >= s.groups:
        cuts = np.linspace(0, n_large, s.groups + 1).astype(int)
        tops = -(-lengths[order[cuts[:-1]]].astype(int) // s.grain)
        sizes, group = np.unique(tops, return_inverse=True)
        need = np.bincount(group, np.diff(cuts))
        columns, use = configurations(sizes, need, s.capacity // s.grain)
        filled = _substitute(columns, np.floor(use + 1e-9).astype(int), sizes * s.grain, order, lengths, s.capacity)
    free = np.array([s.capacity - int(lengths[own].sum()) for own in filled], int)
    bins = None
    for part in s.spare:
        kept = [own for own, room in zip(filled, free) if room <= part * s.capacity]
        inside = np.zeros(len(lengths), bool)
        inside[[x for own in kept for x in own]] = True
        _best_fit(kept, order[~inside[order]].tolist(), lengths, s.capacity)
        if bins is None or len(kept) < len(bins):
            bins = kept
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k, own in enumerate(bins):
        own = np.array(own)
        sequence[own] = k
        offset[own] = np.cumsum(lengths[own]) - lengths[own]
    return sequence, offset


def _substitute(columns: np.ndarray, times: np.ndarray, tops: np.ndarray, order: np.ndarray, lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Configurations filled with actual pieces.

    Each place but the last takes the longest piece that its size allows.  Real pieces are
    shorter than the sizes they were rounded to; the last place gets all of that room, so it
    takes the longest piece of any size that fits, and rounding wastes nothing there.
    """
    held: list[list[int]] = [[] for _ in range(capacity + 1)]
    for x in order[::-1].tolist():
        held[lengths[x]].append(x)
    some = np.array([bool(h) for h in held])
    some[0] = True  # stands for "none fits"
    bins: list[list[int]] = []
    mixes = [sorted(np.repeat(tops, column.astype(int)).tolist(), reverse=True) for column in columns.T]
    for k in sorted(range(len(mixes)), key=lambda k: mixes[k], reverse=True):
        for _ in range(times[k]):
            own, free = [], capacity
            for place, top in enumerate(mixes[k], 1):
                room = free if place == len(mixes[k]) else min(free, top)
                size = room - int(some[room::-1].argmax())
                if size:
                    own.append(held[size].pop())
                    some[size] = bool(held[size])
                    free -= size
            if own:
                bins.append(own)
    return bins


def _best_fit(bins: list[list[int]], items: list[int], lengths: np.ndarray, capacity: int) -> None:
    """Items in the given order into the fullest sequence that still holds them, or a new one."""
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = np.zeros(capacity + 1, bool)
    for k, own in enumerate(bins):
        free = capacity - int(lengths[own].sum())
        open_[free].append(k)
        some[free] = True
    for x in items:
        size = int(lengths[x])
        free = size + int(some[size:].argmax())
        if not some[free]:
            bins.append([])
            free, k = capacity, len(bins) - 1
        else:
            k = open_[free].pop()
            some[free] = bool(open_[free])
        bins[k].append(x)
        open_[free - size].append(k)
        some[free - size] = True


def pack(found: DataFrame, s: PackSettings) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``.  ``found`` must be a stored table: it is read twice."""
    full = found.filter(F.col("length") == s.capacity)
    full = full.withColumn("sequence_id", F.lit(1 << 62) + F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    rest = found.filter(F.col("length") < s.capacity)
    shards = max(1, round(rest.count() / s.shard_pieces))
    dealt = rest.withColumn("_shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        sequence, offset = pack_lengths(rows["length"].to_numpy(), s)
        return rows.drop(columns="_shard").assign(sequence_id=sequence + (int(key[0]) << 32), offset=offset)

    spec = rest.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema
    return full.unionByName(dealt.groupBy("_shard").applyInPandas(run, spec))


def best_fit_packing(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", settings: PackSettings = PackSettings(), with_ids: bool = False) -> DataFrame:
    """A row for each piece of a document: where it starts there, its length and checksum, its sequence and place."""
    return pack(materialize(pieces(docs, doc_id, text, settings, with_ids), "pieces"), settings)
