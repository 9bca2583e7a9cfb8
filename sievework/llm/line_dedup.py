"""Lines that several documents share, kept only in the smallest document; reversible.

The state is exact: a row of references for each line key and document, and a row
of counts (how many documents hold the key, the smallest of them).  Keys are dealt
to shards by hash, and each shard has a cuckoo filter of its keys.  A new batch
asks the filters first: only keys that they may hold are joined with the counts,
all others are new.  Deleting documents takes their references away, recounts just
the keys touched, and deletes keys without documents from the filters, so that
lines of the remaining documents come back as if the deleted ones had never been.

A key is the line without white space at both ends, A-Z lower-cased; keys under
``min_chars`` characters are never dropped.  Keys travel as two 64-bit hashes.

Defined cases: a missing or empty text is one empty line; rows with the same id are
one document; missing ids are one document that sorts after all others; a batch
may hold documents that are there already (their references are not counted twice).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sievework.llm.bytesets import IS_SPACE, LOWER, Texts, byte_keys, run_hashes, slices
from sievework.llm.cuckoo import CuckooFilter
from sievework.llm.tables import known_id, unused
from sievework.session import materialize

_SECOND = byte_keys(29)
_REFS = "k1 long, k2 long, doc long"
_COUNTS = "k1 long, k2 long, n_docs long, first_doc long"
_FILTERS = "shard long, filter binary"
KEY = ["k1", "k2"]


@dataclass(frozen=True)
class LineState:
    """``refs (k1, k2, doc)``, ``counts (k1, k2, n_docs, first_doc)``, ``filters (shard, filter)``; ``shards`` is fixed."""

    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int


def line_keys(texts: Texts, min_chars: int) -> tuple[np.ndarray, ...]:
    """Row, start and end of each line, its two hashes, and whether it is long enough to have a key."""
    row, start, end = texts.lines()
    solid = np.flatnonzero(~IS_SPACE[texts.data])
    low, high = np.searchsorted(solid, start), np.searchsorted(solid, end)
    filled = high > low
    bounded = np.append(solid, 0)
    inner_start = np.where(filled, bounded[low], start)
    inner_end = np.where(filled, bounded[high - 1] + 1, start)
    keyed = texts.code_points(inner_start, inner_end) >= min_chars
    lowered = Texts.__new__(Texts)
    lowered.data, lowered.bounds = LOWER[texts.data], texts.bounds
    one, two = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
    one[keyed] = run_hashes(lowered.data, inner_start[keyed], inner_end[keyed]).view(np.int64)
    two[keyed] = run_hashes(lowered.data, inner_start[keyed], inner_end[keyed], _SECOND).view(np.int64)
    return row, start, end, one, two, keyed


def references(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """Distinct (k1, k2, doc)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                row, _, _, one, two, keyed = line_keys(Texts(part.column("text")), min_chars)
                ids = part.column("doc").to_numpy()[row[keyed]]
                rows = pd.DataFrame({"k1": one[keyed], "k2": two[keyed], "doc": ids}).drop_duplicates()
                yield pa.RecordBatch.from_pandas(rows, preserve_index=False)

    return docs.select(known_id(doc_id).alias("doc"), F.col(f"`{text}`").alias("text")).mapInArrow(run, _REFS).distinct()


def _with_shard(keys: DataFrame, shards: int) -> DataFrame:
    return keys.withColumn("shard", F.pmod(F.xxhash64("k1"), F.lit(shards)))


def _probe(_: tuple, keys: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    known = np.zeros(len(keys), bool)
    if len(filters) and len(keys):
        known = CuckooFilter.load(filters["filter"].iloc[0]).contains(keys["k1"].to_numpy().view(np.uint64))
    return keys[["k1", "k2"]].assign(known=known)


def _change(key: tuple, keys: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    """The shard's filter after deleting (sign -1) and inserting (sign 1) keys."""
    table = CuckooFilter.load(filters["filter"].iloc[0]) if len(filters) else CuckooFilter.sized_for(2 * len(keys))
    hashes, sign = keys["k1"].to_numpy().view(np.uint64), keys["sign"].to_numpy()
    table.delete(hashes[sign < 0])
    try:
        table.insert(hashes[sign > 0])
    except OverflowError:
        return pd.DataFrame({"shard": [key[0]], "filter": [b""]})
    return pd.DataFrame({"shard": [key[0]], "filter": [table.dump()]})


def _rebuild(key: tuple, keys: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"shard": [key[0]], "filter": [CuckooFilter.of(keys["k1"].to_numpy().view(np.uint64)).dump()]})


def _counted(refs: DataFrame) -> DataFrame:
    return refs.groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.min("doc").alias("first_doc"))


def _refilter(state: LineState, changes: DataFrame, counts: DataFrame) -> DataFrame:
    """Filters after ``changes (k1, sign)``; a shard whose filter overflowed is built again from its counts."""
    moved = _with_shard(changes, state.shards).groupBy("shard").cogroup(state.filters.groupBy("shard"))
    filters = materialize(moved.applyInPandas(_change, _FILTERS), "filters")
    full = [r[0] for r in filters.filter("length(filter) = 0").select("shard").collect()]  # at most one per shard
    if not full:
        return filters
    anew = _with_shard(counts.select("k1"), state.shards).filter(F.col("shard").isin(full))
    anew = anew.groupBy("shard").applyInPandas(_rebuild, _FILTERS)
    return materialize(filters.filter("length(filter) > 0").unionByName(anew), "filters")


def empty_state(spark: SparkSession, shards: int) -> LineState:
    """``shards``: about one for every few hundred thousand distinct lines that are to come."""
    return LineState(
        spark.createDataFrame([], _REFS), spark.createDataFrame([], _COUNTS), spark.createDataFrame([], _FILTERS), shards
    )


def insert(state: LineState, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 10) -> LineState:
    """The state with a batch of documents added."""
    return insert_references(state, materialize(references(docs, doc_id, text, min_chars), "line-refs"))


def insert_references(state: LineState, batch: DataFrame) -> LineState:
    """The state with the written :func:`references` of a batch added."""
    added = _counted(batch)
    asked = _with_shard(added.select(*KEY), state.shards)
    probed = asked.groupBy("shard").cogroup(state.filters.groupBy("shard")).applyInPandas(_probe, "k1 long, k2 long, known boolean")
    probed = materialize(added.join(probed, KEY), "line-new")
    known, fresh = probed.filter("known").drop("known"), probed.filter("not known").drop("known")
    # Only keys that the filters may hold meet the old tables.
    met = known.select(*KEY)
    hit = materialize(state.counts.join(met, KEY, "left_semi"), "line-hit")
    again = state.refs.join(hit.select(*KEY), KEY, "left_semi")
    both = batch.join(hit.select(*KEY), KEY, "left_semi").unionByName(again).distinct()
    updated = _counted(both)
    unknown = known.join(hit.select(*KEY), KEY, "left_anti")  # the filter was wrong
    counts = state.counts.join(hit.select(*KEY), KEY, "left_anti").unionByName(updated).unionByName(fresh).unionByName(unknown)
    counts = materialize(counts, "line-counts")
    fresh_refs = batch.join(again, [*KEY, "doc"], "left_anti")
    refs = materialize(state.refs.unionByName(fresh_refs), "line-refs")
    new_keys = fresh.select("k1").unionByName(unknown.select("k1")).withColumn("sign", F.lit(1))
    return LineState(refs, counts, _refilter(state, new_keys, counts), state.shards)


def delete(state: LineState, ids: DataFrame, doc_id: str = "doc_id") -> LineState:
    """The state without the documents whose ids are given."""
    gone = ids.select(known_id(doc_id).alias("doc")).distinct()
    touched = materialize(state.refs.join(gone, "doc", "left_semi").select(*KEY).distinct(), "line-touched")
    refs = materialize(state.refs.join(gone, "doc", "left_anti").select(*KEY, "doc"), "line-refs")
    left = materialize(_counted(refs.join(touched, KEY, "left_semi")), "line-left")
    counts = materialize(state.counts.join(touched, KEY, "left_anti").unionByName(left), "line-counts")
    lost = touched.join(left, KEY, "left_anti").select("k1").withColumn("sign", F.lit(-1))
    return LineState(refs, counts, _refilter(state, lost, counts), state.shards)


def dropped_lines(state: LineState) -> DataFrame:
    """Per document the keys of the lines that it loses: ``doc, lines array<struct<k1,k2>>``."""
    shared = state.counts.filter("n_docs > 1").select(*KEY, "first_doc")
    lost = state.refs.join(shared, KEY).filter("doc <> first_doc")
    return lost.groupBy("doc").agg(F.collect_list(F.struct(*KEY)).alias("lines"))


def kept_lines(
    docs: DataFrame, state: LineState, doc_id: str = "doc_id", text: str = "text", min_chars: int = 10, digest_only: bool = False
) -> DataFrame:
    """``docs`` with the remaining lines as text, and a struct ``(n_lines, n_dropped, kept_sha256)`` as the last column.

    ``digest_only``: the text column is left out.
    """
    key, lost, made, other = unused(docs, "_doc", "_lost", "lines", "_other")
    joined = docs.withColumn(key, known_id(doc_id)).join(dropped_lines(state).toDF(other, lost), F.col(key) == F.col(other), "left")
    joined = joined.drop(other, key)
    names = [c for c in docs.columns if not (digest_only and c == text)]
    kind = "struct<n_lines:bigint,n_dropped:bigint,kept_sha256:string>"
    spec = docs.select(*[F.col(f"`{c}`") for c in names], F.lit(None).cast(kind).alias(made)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                texts = Texts(part.column(text))
                row, start, end, one, two, keyed = line_keys(texts, min_chars)
                data, bounds = texts.data.tobytes(), np.searchsorted(row, np.arange(len(texts) + 1))
                kept, count = [], np.diff(bounds)
                dropped = np.zeros(len(texts), np.int64)
                for i, own in enumerate(part.column(lost).to_pylist()):
                    a, b = bounds[i], bounds[i + 1]
                    stays = np.ones(b - a, bool)
                    if own:
                        gone = {(x["k1"], x["k2"]) for x in own}
                        stays = np.array([not k or (x, y) not in gone for k, x, y in zip(keyed[a:b], one[a:b].tolist(), two[a:b].tolist())])
                    dropped[i] = b - a - stays.sum()
                    if dropped[i]:
                        kept.append(b"\n".join(data[s:e] for s, e, k in zip(start[a:b], end[a:b], stays) if k))
                    else:
                        kept.append(data[texts.bounds[i] : texts.bounds[i + 1]])
                sums = pa.array([hashlib.sha256(k).hexdigest() for k in kept])
                struct = pa.StructArray.from_arrays([pa.array(count), pa.array(dropped), sums], ["n_lines", "n_dropped", "kept_sha256"])
                columns = []
                for c in names:
                    columns.append(part.column(c) if c != text else pa.array(kept, pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays([*columns, struct], [*names, made])

    return joined.mapInArrow(run, spec)


def shards_for(batch: DataFrame, refs_per_shard: int = 200_000) -> int:
    """Shards for the references of a first batch: a shard is one task's group, so lines count, however few documents hold them."""
    return max(1, -(-batch.count() // refs_per_shard))


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 10, digest_only: bool = False) -> DataFrame:
    """All of ``docs`` as one batch into an empty state, then each document's remaining lines."""
    batch = materialize(references(docs, doc_id, text, min_chars), "line-refs")
    state = insert_references(empty_state(docs.sparkSession, shards_for(batch)), batch)
    return kept_lines(docs, state, doc_id, text, min_chars, digest_only)
