"""Toxicity of texts from their nearest labelled examples by TF-IDF cosine.

Learning.  The ``examples`` labelled texts with the smallest hashes of their ids (a
bounded sample) are the examples.  All their terms (runs of letters, lower-cased) span
the vectors.  A term's weight is its idf; one that tells the labels apart by the
log-likelihood ratio of its occurrences in either class weighs ``emphasis`` times more.
Occurrences between the same neighbours count once, so that copies of one text do not
make its words look telling.  No term is left out for its label.

Scoring.  One pass over all texts counts in how many of them each term is.  The
examples' normalised vectors form an inverted index: examples that resemble each other stand
together in blocks, and per term and block the index knows the largest weight.  A text's
bound for a block is the sum of its terms' largest weights there; the block of the largest bound is
read first, and then only blocks whose bounds reach the last neighbour's cosine found there.
What is read is summed exactly, so the neighbours are exact.  A
term that no example holds meets nothing and counts in the text's norm only, with the
idf of a term of one text.  The neighbours' labels vote, weighted by cosine, together
with the share of positives among the examples as a prior vote; the score is calibrated
on the examples themselves.  An example is never its own neighbour, neither there nor when it is scored.

Terms are cut and hashed (64 bits) from the bytes of whole batches.

Defined cases: missing and empty texts, and those without any term, score the share of
positives among the examples; so does every text without examples (0 then) or with
labels of one kind only; ties of cosine go to the smaller example id; repeated rows are
scored alike; of an id with several texts the smallest text is the example.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from sievework.llm.bytesets import Texts, mix, run_hashes, slices
from sievework.llm.tables import known_id
from sievework.session import materialize


@dataclass(frozen=True)
class ToxicSettings:
    #: Labelled texts that become examples, at most.
    examples: int = 6000
    neighbours: int = 15
    #: Least log-likelihood ratio of a telling term.
    telling: float = 20.0
    #: Least rate of positive contexts of a telling term, as a multiple of the rate of all; words that a
    #: language with more positives merely uses weigh no more than others.
    lift: float = 3.0
    #: Weight of a telling term beside its idf; other terms have 1.
    emphasis: float = 100.0
    #: Weight of the prior vote, in neighbours of cosine 1.
    prior_weight: float = 0.5


#: Texts that are multiplied with the frequent terms' weights at once.
_TEXTS_AT_ONCE = 64
#: Texts whose results a task holds at once.
_KNOWN_HELD = 10_000
_NOT_LETTERS = r"[^\p{L}]+"
_CONTEXT_KEYS = np.random.default_rng(29).integers(1 << 62, 1 << 63, 3, dtype=np.uint64) | np.uint64(1)


def terms_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms in order, and the number of terms of each row."""
    letters = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(column, "")), _NOT_LETTERS, " ")
    texts = Texts(letters)
    starts, ends = texts.words()
    return run_hashes(texts.data, starts, ends), texts.per_row(starts)


def term_counts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and number of its occurrences, by row and then term."""
    hashes, per_row = terms_of(column)
    rows = np.repeat(np.arange(len(per_row)), per_row)
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(first)
    return rows[at], hashes[at], np.diff(np.append(at, len(rows)))


def _train_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            hashes, per_row = terms_of(part.column("text"))
            row = np.repeat(np.arange(len(per_row)), per_row)
            padded = np.concatenate([[0], hashes, [0]]).astype(np.uint64)
            edge = np.concatenate([[-1], row, [-1]])
            before = np.where(edge[:-2] == row, padded[:-2], np.uint64(0))
            after = np.where(edge[2:] == row, padded[2:], np.uint64(0))
            context = mix(before * _CONTEXT_KEYS[0] + hashes * _CONTEXT_KEYS[1] + after * _CONTEXT_KEYS[2])
            label = part.column("label").to_numpy()[row]
            _, at = np.unique(context + label.astype(np.uint64), return_index=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(context[at].view(np.int64)), pa.array(hashes[at].view(np.int64)), pa.array(label[at].astype(np.int32))],
                ["context", "term", "label"],
            )


def weighted_terms(examples: DataFrame, s: ToxicSettings) -> pd.DataFrame:
    """``term, weight`` of all terms (hashes) of the examples; ``emphasis`` where positive contexts are far more than by chance."""
    contexts = examples.mapInArrow(_train_contexts, "context long, term long, label int").distinct()
    counts = contexts.groupBy("term").agg(F.sum("label").alias("p"), F.count("*").alias("n"))
    counts = materialize(counts, "terms")
    total = counts.agg(F.sum("p").alias("p"), F.sum("n").alias("n")).first()
    weight = F.lit(1.0)
    if total["p"] and total["p"] < total["n"]:
        rate = float(total["p"] / total["n"])

        def part(k: Column, share: float) -> Column:
            return F.when(k > 0, k * F.log(k / (F.col("n") * share))).otherwise(0.0)

        ratio = 2 * (part(F.col("p"), rate) + part(F.col("n") - F.col("p"), 1 - rate))
        told = (F.col("p") >= min(s.lift * rate, (1 + rate) / 2) * F.col("n")) & (ratio >= s.telling)
        weight = F.when(told, s.emphasis).otherwise(1.0)
    return counts.select("term", weight.alias("weight")).orderBy("term").toPandas()  # bounded by the sample


def _places(known: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each term stands among the sorted known ones, and whether it does."""
    at = np.minimum(np.searchsorted(known, terms), max(0, len(known) - 1))
    return at, known[at] == terms if len(known) else np.zeros(len(terms), bool)


def text_frequencies(rows: DataFrame, known: np.ndarray) -> tuple[int, np.ndarray]:
    """The number of texts, and of texts with each of the sorted terms; a task hands on one row a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = np.zeros(len(known), np.int64), 0
        for batch in batches:
            for part in slices(batch, "text"):
                at, there = _places(known, term_counts(part.column("text"))[1])
                seen += np.bincount(at[there], minlength=len(known))
                total += part.num_rows
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[at], total))], ["t", "n"])

    found = rows.select("text").mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).toPandas()  # one per term
    t, n = found["t"].to_numpy(np.int64), found["n"].to_numpy(np.int64)
    out = np.zeros(len(known), np.int64)
    out[t[t >= 0]] = n[t >= 0]
    return int(n[t < 0].sum()), out


def _spans(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    size = (high - low).astype(np.int64)
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - (ends - size), size)


class BlockIndex:
    """Examples' unit vectors as postings by term, cut into blocks of examples; exact nearest by cosine."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, ids: np.ndarray, n_terms: int, block: int = 256, common: int = 16):
        terms = np.concatenate([v[0] for v in vectors]).astype(np.int64) if vectors else np.zeros(0, np.int64)
        weights = np.concatenate([v[1] for v in vectors]) if vectors else np.zeros(0)
        rows = np.repeat(np.arange(len(vectors)), [len(v[0]) for v in vectors])
        order = _alike(vectors, terms, weights, rows, n_terms)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.labels, self.ids, self.size, self.common = labels[order], ids[order], block, common
        rows = place[rows]
        by = np.lexsort((rows, terms))
        self.start = np.searchsorted(terms[by], np.arange(n_terms + 1)).astype(np.int32)
        self.rows, self.weights = rows[by].astype(np.int32), weights[by]
        #: Blocks read since the index was made.
        self.read = 0
        self._prepare()

    def __getstate__(self) -> dict:
        """Only the postings travel; what follows from them is made where they arrive."""
        return {k: v for k, v in self.__dict__.items() if k in ("labels", "ids", "size", "common", "start", "rows", "weights", "read")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._prepare()

    def _prepare(self) -> None:
        count = len(self.ids)
        self.blocks = -(-count // self.size)
        # Terms of more than one in ``common`` examples are held as whole rows, to be multiplied for many texts at once.
        held = np.diff(self.start)
        frequent = np.flatnonzero(held * self.common > count)
        self.place = np.full(len(held), -1, np.int32)
        self.place[frequent] = np.arange(len(frequent))
        self.dense = np.zeros((len(frequent), count))
        for n, term in enumerate(frequent):
            own = slice(self.start[term], self.start[term + 1])
            self.dense[n, self.rows[own]] = self.weights[own]
        # A piece is what one term has in one block: where its postings begin, and the largest weight among them.
        term, of = np.repeat(np.arange(len(held), dtype=np.int32), held), (self.rows // self.size).astype(np.int16)
        new = np.ones(len(of), bool)
        new[1:] = (term[1:] != term[:-1]) | (of[1:] != of[:-1])
        at = np.flatnonzero(new)
        self.piece = np.append(at, len(of)).astype(np.int32)
        self.piece_block = of[at]
        self.largest = np.maximum.reduceat(self.weights, at) if len(at) else np.zeros(0)
        self.piece_start = np.searchsorted(term[at], np.arange(len(held) + 1)).astype(np.int32)

    def shares(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the frequent terms of each text add to its cosine with each example."""
        asked = np.zeros((len(vectors), len(self.dense)))
        for n, (terms, weights) in enumerate(vectors):
            at = self.place[terms]
            asked[n, at[at >= 0]] = weights[at >= 0]
        return asked @ self.dense

    def _cosines(self, first: int, last: int, pieces: np.ndarray, own: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines above zero of the blocks from ``first`` to before ``last``."""
        self.read += last - first
        found = share[first * self.size : last * self.size]
        block = self.piece_block[pieces]
        here = (block >= first) & (block < last)
        if here.any():
            pieces = pieces[here]
            low, high = self.piece[pieces], self.piece[pieces + 1]
            posts = _spans(low, high)
            add = np.repeat(own[here], high - low) * self.weights[posts]
            found = found + np.bincount(self.rows[posts] - first * self.size, add, minlength=len(found))
        found = np.round(found, 12)
        rows = np.flatnonzero(found > 0)
        return rows + first * self.size, found[rows]

    def nearest(
        self, terms: np.ndarray, weights: np.ndarray, k: int, without: int | None = None, share: np.ndarray | None = None
    ) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the k nearest examples with cosine above zero; ``share`` is this text's row of :meth:`shares`.

        If many blocks promise far less than the best one, that gives a cosine to beat.  Then all blocks whose bounds reach it are
        read, side by side ones at once.
        """
        terms = np.asarray(terms, np.int64)
        if not len(self.ids) or not len(terms):
            return np.zeros(0, int), np.zeros(0)
        share = self.shares([(terms, weights)])[0] if share is None else share
        rare = self.place[terms] < 0
        terms = terms[rare]
        low, high = self.piece_start[terms], self.piece_start[terms + 1]
        pieces, own = _spans(low, high), np.repeat(weights[rare], high - low)
        bounds = np.maximum.reduceat(share, np.arange(0, len(share), self.size))
        bounds = bounds + np.bincount(self.piece_block[pieces], own * self.largest[pieces], minlength=self.blocks)

        def best(rows: np.ndarray, cosines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if without is not None:
                other = self.ids[rows] != without
                rows, cosines = rows[other], cosines[other]
            if len(rows) > k:
                high = cosines >= np.partition(cosines, -k)[-k]
                rows, cosines = rows[high], cosines[high]
            order = np.lexsort((self.ids[rows], -cosines))[:k]
            return rows[order], cosines[order]

        top = int(bounds.argmax())
        rows, cosines, least = np.zeros(0, int), np.zeros(0), 0.0
        if (bounds < bounds[top] / 2).sum() * 4 > self.blocks:  # else there is hardly a block to skip
            rows, cosines = best(*self._cosines(top, top + 1, pieces, own, share))
            least = cosines[-1] if len(cosines) == k else 0.0
        open_ = np.flatnonzero((bounds + 1e-9 >= least) & (bounds > 0))
        if len(open_) > (1 if least else 0) or (len(open_) and open_[0] != top):
            runs = np.split(open_, np.flatnonzero(np.diff(open_) > 2) + 1)
            parts = [self._cosines(int(r[0]), int(r[-1]) + 1, pieces, own, share) for r in runs]
            rows, cosines = best(*(np.concatenate(x) for x in zip(*parts)))
        return rows, cosines


def _alike(vectors: list, terms: np.ndarray, weights: np.ndarray, rows: np.ndarray, n_terms: int, pivots: int = 32) -> np.ndarray:
    """An order of the vectors in which like ones stand together: by the nearest of some pivots, like pivots side by side."""
    if not vectors:
        return np.zeros(0, int)
    chosen = np.unique(np.linspace(0, len(vectors) - 1, pivots).astype(int))
    cosines = np.empty((len(chosen), len(vectors)))
    for n, pivot in enumerate(chosen):
        dense = np.zeros(n_terms)
        dense[vectors[pivot][0]] = vectors[pivot][1]
        cosines[n] = np.bincount(rows, dense[terms] * weights, minlength=len(vectors))
    chain, left = [0], set(range(1, len(chosen)))
    while left:
        chain.append(max(left, key=lambda n: (cosines[chain[-1], chosen[n]], -n)))
        left.remove(chain[-1])
    return np.lexsort((-cosines.max(axis=0), np.argsort(chain)[cosines.argmax(axis=0)]))


def _isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the monotone regression of y on x."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b in zip(x[order], y[order]):
        if pools and pools[-1][3] == a:
            pools[-1][0] += b
            pools[-1][1] += 1
        else:
            pools.append([b, 1.0, a, a])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            b2, n2, _, high = pools.pop()
            pools[-1][0] += b2
            pools[-1][1] += n2
            pools[-1][3] = high
    return np.array([(p[2] + p[3]) / 2 for p in pools]), np.array([p[0] / p[1] for p in pools])


@dataclass
class Model:
    #: Sorted hashes of the terms, idf times weight of each, and the idf of a term that no example holds.
    terms: np.ndarray
    scale: np.ndarray
    strange: float
    index: BlockIndex
    share: float
    knots: tuple[np.ndarray, np.ndarray]
    settings: ToxicSettings

    def units(self, column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per text places and weights of its terms that some example holds, as part of its whole unit vector."""
        row, term, count = term_counts(column)
        at, known = _places(self.terms, term)
        weight = (1 + np.log(count)) * (np.where(known, self.scale[at], self.strange) if len(self.terms) else self.strange)
        norm = np.sqrt(np.bincount(row, weight * weight, minlength=len(column)))
        row, at, weight = row[known], at[known], weight[known] / norm[row[known]]
        ends = np.searchsorted(row, np.arange(len(column) + 1))
        return [(at[a:b], weight[a:b]) for a, b in zip(ends[:-1], ends[1:])]

    def vote(self, terms: np.ndarray, weights: np.ndarray, without: int | None, share: np.ndarray) -> tuple[float, list[int]]:
        rows, cosines = self.index.nearest(terms, weights, self.settings.neighbours, without, share)
        prior = self.settings.prior_weight
        share = (float(cosines @ self.index.labels[rows]) + prior * self.share) / (float(cosines.sum()) + prior)
        return share, self.index.ids[rows].tolist()

    def votes(self, vectors: list[tuple[np.ndarray, np.ndarray]], without: list[int | None]) -> Iterator[tuple[float, list[int]]]:
        for low in range(0, len(vectors), _TEXTS_AT_ONCE):
            some = vectors[low : low + _TEXTS_AT_ONCE]
            for (terms, weights), own, share in zip(some, without[low:], self.index.shares(some)):
                yield self.vote(terms, weights, own, share) if len(terms) else (np.nan, [])

    def scores(self, vectors: list[tuple[np.ndarray, np.ndarray]], without: list[int | None]) -> list[tuple[float, list[int]]]:
        return [(self.share if np.isnan(v) else float(np.interp(v, *self.knots)), near) for v, near in self.votes(vectors, without)]


def fit(examples: pa.Table, terms: np.ndarray, scale: np.ndarray, strange: float, s: ToxicSettings) -> Model:
    """``examples``: doc, label, text of the bounded sample."""
    labels = examples.column("label").to_numpy().astype(float)
    share = float(labels.mean()) if len(labels) else 0.0
    ids = examples.column("doc").to_numpy().astype(np.int64)
    model = Model(terms, scale, strange, BlockIndex([], labels[:0], ids[:0], len(terms)), share, (np.array([0.0, 1.0]),) * 2, s)
    vectors = [v for batch in examples.to_batches() for part in slices(batch, "text") for v in model.units(part.column("text"))]
    holds = np.array([len(t) > 0 for t, _ in vectors], bool)
    if holds.any():
        vectors = [v for v, h in zip(vectors, holds) if h]
        model.index = BlockIndex(vectors, labels[holds], ids[holds], len(terms))
        votes = np.array([v for v, _ in model.votes(vectors, ids[holds].tolist())])
        model.knots = _isotonic(votes, labels[holds])
    return model


def toxicity(
    docs: DataFrame, labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", settings: ToxicSettings = ToxicSettings()
) -> DataFrame:
    """``doc_id, score, evidence`` for every row of ``docs``; ``labelled`` has ids and 0/1 labels to learn from.

    ``evidence`` lists the ids of the nearest examples, nearest first.
    """
    s = settings
    rows = docs.select(known_id(doc_id).alias("doc"), F.col(f"`{text}`").alias("text"))
    usable = labelled.select(F.col(f"`{doc_id}`").cast("long").alias("doc"), F.col(f"`{label}`").cast("int").alias("label"))
    usable = usable.filter("doc is not null and label in (0, 1)").groupBy("doc").agg(F.max("label").alias("label"))
    chosen = usable.orderBy(F.xxhash64("doc"), "doc").limit(s.examples)
    chosen = F.broadcast(materialize(chosen, "examples"))  # at most ``examples`` rows
    sample = rows.join(chosen, "doc").groupBy("doc").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    sample = materialize(sample, "example-texts")
    terms = weighted_terms(sample.select("text", "label"), s)
    known = terms["term"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(known)
    known = known[order]
    total, seen = text_frequencies(rows, known)
    idf = np.log((1 + total) / (1 + seen)) + 1
    scale = idf * terms["weight"].to_numpy(float)[order]
    model = fit(sample.select("doc", "label", "text").toArrow(), known, scale, float(np.log((1 + total) / 2) + 1), s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[float, list[int]]] = {}
        own = set(model.index.ids.tolist())
        for batch in batches:
            for part in slices(batch, "text"):
                docs = [d if d in own else None for d in part.column("doc").to_pylist()]
                texts = part.column("text").to_pylist()
                keys = [(hashlib.blake2b((t or "").encode(), digest_size=16).digest(), d) for t, d in zip(texts, docs)]
                new = {key: n for n, key in reversed(list(enumerate(keys))) if key not in held}
                vectors = model.units(part.column("text"))
                if len(held) > _KNOWN_HELD:
                    new, held = {key: n for n, key in enumerate(keys)}, {}
                held.update(zip(new, model.scores([vectors[n] for n in new.values()], [docs[n] for n in new.values()])))
                out = [held[key] for key in keys]
                score, near = (pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.float64(), pa.list_(pa.int64()))))
                yield pa.RecordBatch.from_arrays([part.column("doc"), score, near], ["doc", "score", "evidence"])

    scored = rows.mapInArrow(run, "doc long, score double, evidence array<long>")
    return scored.select(F.nullif("doc", F.lit((1 << 63) - 1)).alias("doc_id"), "score", "evidence")
