"""Similarity join on word shingles by a MinHash LSH forest, every link verified exactly.

1. A text becomes the set of its distinct windows of ``words`` words.  Texts with
   equal sets are one class; all that follows works on classes.
2. Each class has a signature of min-hashes, cut into the paths of ``trees``
   prefix tries.  Two classes meet in a tree if their paths share a prefix.  The
   prefix starts at ``max_depth`` min-hashes and is shortened until a pair at the
   threshold meets in at least one tree with probability ``recall``
   (:func:`prefix_depth`).  Nodes are found by sorting on the prefix; those with one
   class are done.  A node with more than ``block`` classes is cut into blocks by hash,
   and pairs of blocks are worked on by different tasks, so no task holds a hot node.
3. Inside a node, sketches (one byte of 64 min-hashes) estimate similarity.  Pairs
   clearly below the threshold are left; of all others only a spanning forest is
   emitted, never the pairs.  Connected components of it are the candidates.
4. Components are verified exactly from the shingle sets, again by pairs of blocks:
   intersections of all pairs of a block are matrix products inside the task, which
   emits a number of links per class and a spanning forest of the true links.

The result has a row for each document: the class (smallest id that true links lead
to) and the number of other documents at ``threshold`` or more, copies included.

Defined cases: missing and empty texts have no shingles and link to nothing; a text
with fewer words than a window is one shingle; a missing id counts as the largest
id; repeated rows are documents of their own that link to each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sievework.llm.bytesets import mix, shingle_sets, slices
from sievework.llm.tables import components, given_id, known_id, unused
from sievework.session import materialize

_SKETCH = 64


@dataclass(frozen=True)
class JoinSettings:
    words: int = 5
    threshold: float = 0.8
    trees: int = 16
    max_depth: int = 6
    recall: float = 0.9995
    #: Classes that a task compares with each other at once.
    block: int = 256


def prefix_depth(s: JoinSettings) -> int:
    """The longest prefix with which a pair at the threshold meets in some tree often enough."""
    depth = s.max_depth
    while depth > 1 and 1 - (1 - s.threshold**depth) ** s.trees < s.recall:
        depth -= 1
    return depth


def _minhashes(values: np.ndarray, n: int) -> np.ndarray:
    keys = np.random.default_rng(5).integers(1, 1 << 63, (2, n), dtype=np.uint64)
    add, times = keys[0][:, None], keys[1][:, None] | np.uint64(1)
    found = np.full(n, (1 << 64) - 1, np.uint64)
    for i in range(0, len(values), 4096):
        part = (values[None, i : i + 4096] ^ add) * times
        np.minimum(found, (part ^ (part >> np.uint64(32))).min(axis=1), out=found)
    return found


def _set_digest(values: np.ndarray) -> bytes:
    return np.array([mix(values).sum(), mix(values ^ np.uint64(0x5851F42D4C957F2D)).sum()], np.uint64).tobytes()


def signatures(docs: DataFrame, doc_id: str, text: str, s: JoinSettings) -> DataFrame:
    """``doc, cls binary, size int, nodes array<long>, sketch binary``; nulls without shingles."""
    depth, n = prefix_depth(s), max(s.trees * s.max_depth, _SKETCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                cls, size, nodes, sketch = [], [], [], []
                for values in shingle_sets(part.column("text"), s.words):
                    size.append(len(values))
                    if not len(values):
                        for column in (cls, nodes, sketch):
                            column.append(None)
                        continue
                    mins = _minhashes(values, n)
                    paths = mins[: s.trees * s.max_depth].reshape(s.trees, s.max_depth)
                    node = np.arange(1, s.trees + 1, dtype=np.uint64)
                    for j in range(depth):
                        node = mix(node ^ paths[:, j]) + np.uint64(j)
                    cls.append(_set_digest(values))
                    nodes.append(node.view(np.int64))
                    sketch.append(mix(mins[:_SKETCH]).astype(np.uint8).tobytes())
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), pa.array(cls, pa.binary()), pa.array(size, pa.int32()), pa.array(nodes, longs),
                     pa.array(sketch, pa.binary())],
                    ["doc", "cls", "size", "nodes", "sketch"],
                )

    rows = docs.select(known_id(doc_id).alias("doc"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, "doc long, cls binary, size int, nodes array<long>, sketch binary")


def block_pairs(rows: DataFrame, group: str, block: int) -> DataFrame:
    """Rows of groups of two or more, dealt so that every pair of a group meets in a task of bounded size.

    Columns ``part`` (one task's unit) and ``side``: within a unit rows of side 0
    meet rows of side 1; if a unit has one side only, they meet each other.
    """
    sizes = rows.groupBy(group).agg(F.count("*").alias("_n")).filter("_n > 1")
    members = rows.join(sizes, group).withColumn("_blocks", F.ceil(F.col("_n") / block).cast("int"))
    own = F.when(F.col("_blocks") > 1, F.pmod(F.xxhash64("cls"), F.col("_blocks")).cast("int")).otherwise(F.lit(0))
    members = members.withColumn("_own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    dealt = members.select("*", other.alias("_other"))
    low, high = F.least("_own", "_other"), F.greatest("_own", "_other")
    return dealt.select(
        *rows.columns, F.xxhash64(group, low, high).alias("part"), (F.col("_own") > F.col("_other")).cast("int").alias("side"),
        (F.col("_own") != F.col("_other")).alias("cross"),
    )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one ``part`` after the other; a part is bounded by its two blocks."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        part = batch.column(batch.schema.get_field_index("part")).to_numpy()
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1), len(part)]
        for a, b in zip(cuts, cuts[1:]):
            if held and held[0].column(held[0].schema.get_field_index("part"))[0].as_py() != part[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _roots(linked: np.ndarray) -> np.ndarray:
    """For a symmetric matrix of links the smallest index reachable from each index."""
    root = np.arange(len(linked))
    while True:
        near = np.where(linked, root[None, :], len(root)).min(axis=1, initial=len(root))
        new = np.minimum(root, near)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _in_units(rows: DataFrame, work: Callable[[pa.Table], pa.RecordBatch | None], spec: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _runs(batches):
            if unit.num_rows > 1 and (made := work(unit)) is not None:
                yield made

    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(run, spec)


def _meeting(unit: pa.Table) -> np.ndarray:
    """Which pairs of a unit are this unit's to compare."""
    n, side = unit.num_rows, unit.column("side").to_numpy()
    if unit.column("cross")[0].as_py():
        return side[:, None] != side[None, :]
    return ~np.eye(n, dtype=bool)


def candidate_edges(classes: DataFrame, s: JoinSettings) -> DataFrame:
    """Spanning forests (a, b) of the classes that may be linked, from all nodes of all trees."""
    least = s.threshold - 4 * (s.threshold * (1 - s.threshold) / _SKETCH) ** 0.5  # four standard errors

    def forest(unit: pa.Table) -> pa.RecordBatch | None:
        sketch = np.frombuffer(b"".join(unit.column("sketch").to_pylist()), np.uint8).reshape(-1, _SKETCH)
        equal = np.zeros((len(sketch), len(sketch)), np.uint8)
        for j in range(_SKETCH):
            equal += sketch[:, j, None] == sketch[None, :, j]
        likely = (equal / _SKETCH >= least) & _meeting(unit)
        root = _roots(likely)
        moved = np.flatnonzero(root != np.arange(len(root)))
        if not len(moved):
            return None
        cls = unit.column("cls").combine_chunks()
        return pa.RecordBatch.from_arrays([cls.take(pa.array(moved)), cls.take(pa.array(root[moved]))], ["a", "b"])

    rows = classes.select(F.explode("nodes").alias("node"), "cls", "sketch")
    dealt = block_pairs(rows, "node", s.block)
    return _in_units(dealt, forest, "a binary, b binary").distinct()


def verified_links(members: DataFrame, s: JoinSettings) -> DataFrame:
    """From ``cls, root, copies, shingles`` rows ``cls, other, links``: true links, weighted by the partner's copies.

    ``other`` spans the true links.
    """

    def links(unit: pa.Table) -> pa.RecordBatch | None:
        sets = unit.column("shingles").combine_chunks()
        at = sets.offsets.to_numpy()
        values = sets.values.to_numpy()[at[0] : at[-1]]
        size = np.diff(at)
        owner = np.repeat(np.arange(len(size)), size)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        first = np.concatenate([[True], values[1:] != values[:-1]])
        column = np.cumsum(first) - 1
        many = np.bincount(column) > 1
        keep = many[column]
        column, owner = (np.cumsum(many) - 1)[column[keep]], owner[keep]
        common, width = np.zeros((len(size), len(size)), np.float64), 4096
        for low in range(0, int(many.sum()), width):
            a, b = np.searchsorted(column, [low, low + width])
            block = np.zeros((len(size), width), np.float32)
            block[owner[a:b], column[a:b] - low] = 1
            common += block @ block.T
        either = size[:, None] + size[None, :] - common
        true = (common >= s.threshold * either - 1e-9) & _meeting(unit)
        if not true.any():
            return None
        root = _roots(true)
        copies = unit.column("copies").to_numpy()
        count = (true * copies[None, :]).sum(axis=1)
        some = np.flatnonzero(count)
        cls = unit.column("cls").combine_chunks()
        return pa.RecordBatch.from_arrays(
            [cls.take(pa.array(some)), cls.take(pa.array(root[some])), pa.array(count[some].astype(np.int64))], ["cls", "other", "links"]
        )

    dealt = block_pairs(members, "root", s.block).drop("root")
    return _in_units(dealt, links, "cls binary, other binary, links long")


def repeats_ids(signed: DataFrame) -> bool:
    """Whether some id (missing ones count as one) stands at several rows, so that an id alone does not name a text."""
    return not signed.groupBy("doc").agg(F.count("*").alias("rows")).filter("rows > 1").isEmpty()


def _with_digest(rows: DataFrame, text: str, cls: str, words: int) -> DataFrame:
    """The rows with shingles, with the digest of their set as a last column ``cls``."""
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                digests = [_set_digest(v) if len(v) else None for v in shingle_sets(part.column(at), words)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(digests, pa.binary())], [*part.schema.names, cls])

    spec = rows.select("*", F.lit(None).cast("binary").alias(cls)).schema
    return rows.mapInArrow(run, spec).filter(F.col(cls).isNotNull())


def _sets_of(docs: DataFrame, members: DataFrame, doc_id: str, text: str, words: int, repeated: bool) -> DataFrame:
    """The shingle sets of the classes' first documents: ``cls, root, copies, shingles``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = list(shingle_sets(part.column("text"), words))
                right = [i for i, v in enumerate(sets) if len(v) and _set_digest(v) == part.column("cls")[i].as_py()]
                kept = part.take(pa.array(right, pa.int64()))
                lists = pa.array([sets[i].view(np.int64) for i in right], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [kept.column("cls"), kept.column("root"), kept.column("copies"), lists], ["cls", "root", "copies", "shingles"]
                )

    rows = docs.select(known_id(doc_id).alias("doc"), F.col(f"`{text}`").alias("text"))
    on = F.col("doc") == F.col("first")
    if repeated:  # the texts of one id must not each meet all classes of that id
        rows = _with_digest(rows, "text", "_set", words).dropDuplicates(["doc", "_set"])
        on &= F.col("_set") == F.col("cls")
    joined = rows.join(members, on)
    found = joined.select("text", "cls", "root", "copies").mapInArrow(run, "cls binary, root binary, copies long, shingles array<long>")
    return found


def link_classes(docs: DataFrame, signed: DataFrame, doc_id: str, text: str, s: JoinSettings) -> DataFrame:
    """A row for each class with shingles: ``cls, first, copies, class_id, chosen, n_links``.

    ``chosen`` marks one class of each component: the smallest id, and of several sets under
    that id the smallest set.  ``class_id`` does not tell components apart where ids repeat.
    """
    counted = signed.filter("cls is not null").groupBy("cls").agg(
        F.min("doc").alias("first"), F.count("*").alias("copies"), F.first("nodes").alias("nodes"),
        F.first("sketch").alias("sketch"),
    )
    classes = materialize(counted, "classes")
    maybe = components(candidate_edges(classes, s))
    narrow = classes.select("cls", "first", "copies")
    members = narrow.join(maybe.withColumnRenamed("node", "cls"), "cls")
    sets = materialize(_sets_of(docs, members, doc_id, text, s.words, repeats_ids(signed)), "shingles")
    true = materialize(verified_links(sets, s), "links")
    group = components(true.select(F.col("cls").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "cls")
    links = true.groupBy("cls").agg(F.sum("links").alias("links"))
    linked = narrow.join(group, "cls").join(links, "cls")
    linked = materialize(linked, "linked")
    best = linked.groupBy("root").agg(F.min(F.struct("first", "cls")).alias("best"))
    marked = linked.join(best, "root").select("cls", "best", "links")
    return narrow.join(marked, "cls", "left").select(
        "cls", "first", "copies", F.coalesce("best.first", "first").alias("class_id"),
        (F.coalesce("best.cls", "cls") == F.col("cls")).alias("chosen"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )


def ngram_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", settings: JoinSettings = JoinSettings()) -> DataFrame:
    """``doc_id, class_id, n_links`` for every row of ``docs``."""
    signed = materialize(signatures(docs, doc_id, text, settings), "signatures")
    classes = link_classes(docs, signed, doc_id, text, settings).select("cls", "class_id", "n_links")
    found = signed.select("doc", "cls").join(classes, "cls", "left")
    return found.select(
        given_id("doc").alias("doc_id"), F.nullif(F.coalesce("class_id", "doc"), F.lit((1 << 63) - 1)).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", settings: JoinSettings = JoinSettings()) -> DataFrame:
    """One row of each component of near copies (the smallest id), with the columns of ``docs``.

    Texts without shingles are kept.  Of rows that repeat both the id and the set of
    shingles one stays; rows that share an id (or have none) and are no near copies all stay.
    """
    key, cls, first, same = unused(docs, "_doc", "_cls", "_keep", "_set")
    signed = materialize(signatures(docs, doc_id, text, settings), "signatures")
    chosen = link_classes(docs, signed, doc_id, text, settings).filter("chosen").select(F.col("first").alias(first), F.col("cls").alias(same))
    chosen = materialize(chosen, "kept")
    rows = docs.withColumn(key, known_id(doc_id))
    if repeats_ids(signed):
        filled = F.coalesce(F.col(f"`{text}`").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
        # Copies go before the join, so an id or text that many rows repeat is no hot key.
        single = _with_digest(rows.filter(filled), text, cls, settings.words).dropDuplicates([key, cls])
        kept = single.join(chosen, (F.col(key) == F.col(first)) & (F.col(cls) == F.col(same)))
        kept = kept.select(*[F.col(f"`{c}`") for c in docs.columns])
        return kept.unionByName(rows.filter(~filled).select(kept.columns))
    bare = signed.filter("cls is null").select(F.col("doc").alias(first))
    kept = rows.join(chosen.select(first).unionByName(bare), F.col(key) == F.col(first))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
