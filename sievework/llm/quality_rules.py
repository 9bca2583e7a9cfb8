"""Rules on texts, added up by host: a host whose documents mostly fail loses them all.

A document fails its base rules if it has fewer than ``min_words`` words, or if
words inside repeated windows make up more than ``max_repeat_percent`` of it.
Failures are added up by host.  The rate of a host is shrunk towards all hosts by
a beta prior fitted to the hosts' own rates, so a host with few documents is not
judged by them alone.  A document is kept if it passes and its host's shrunk rate
is at most ``max_host_rate``.

Defined cases: a missing text is an empty one and fails; a missing host is a host
of its own; repeated rows count each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sievework.llm.bytesets import Texts, mix, run_hashes, slices, window_hashes
from sievework.llm.tables import unused
from sievework.session import materialize

_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
#: A table of hosts up to this many rows is broadcast, a larger one is joined by shuffle.
BROADCAST_HOSTS = 100_000


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 20
    window: int = 8
    max_repeat_percent: int = 30
    max_host_rate: float = 0.5


def _of_row(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    return mix(hashes + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def text_stats(column: pa.Array, window: int) -> dict[str, np.ndarray]:
    """The five counts of each text."""
    texts = Texts(column)
    starts, ends = texts.words()
    per_row = texts.per_row(starts)
    rows = np.arange(len(texts))
    word_row = np.repeat(rows, per_row)
    chars = np.bincount(word_row, texts.code_points(starts, ends), len(texts))

    line_row, line_start, line_end = texts.lines()
    filled = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_row = line_row[filled]
    keys = _of_row(run_hashes(texts.data, line_start[filled], line_end[filled]), line_row)
    _, first = np.unique(keys, return_index=True)
    again = np.bincount(line_row, minlength=len(texts)) - np.bincount(line_row[first], minlength=len(texts))

    windows, place = window_hashes(run_hashes(texts.data, starts, ends), per_row, window)
    keys = _of_row(windows, word_row[place])
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    covered = np.zeros(len(starts) + 1, np.int64)
    if len(twice):
        found = place[twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys]
        covered[found] += 1
        np.subtract.at(covered, found + window, 1)
    repeated = np.bincount(word_row[np.cumsum(covered)[:-1] > 0], minlength=len(texts))
    symbols = texts.per_row(np.flatnonzero(_SYMBOLS[texts.data]))
    return dict(zip(_STATS, (per_row, chars.astype(np.int64), symbols, again, repeated)))


def with_stats(docs: DataFrame, text: str, rules: QualityRules, name: str) -> DataFrame:
    """``docs`` with a struct column ``name`` of the counts and ``base_failed``; one row in, one row out."""
    kind = "struct<" + ",".join(f"{s}:bigint" for s in _STATS) + ",base_failed:boolean>"
    at, window, least, percent = docs.columns.index(text), rules.window, rules.min_words, rules.max_repeat_percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.schema.names[at]):
                stats = text_stats(part.column(at), window)
                failed = (stats["n_words"] < least) | (100 * stats["n_repeat_words"] > percent * stats["n_words"])
                arrays = [pa.array(v.astype(np.int64)) for v in stats.values()] + [pa.array(failed)]
                struct = pa.StructArray.from_arrays(arrays, [*stats, "base_failed"])
                yield pa.RecordBatch.from_arrays([*part.columns, struct], [*part.schema.names, name])

    spec = docs.select("*", F.lit(None).cast(kind).alias(name)).schema
    return docs.mapInArrow(run, spec)


def host_verdicts(stats: DataFrame, host: str, failed: Column, rules: QualityRules) -> DataFrame:
    """One row per host: ``host, n_docs, n_failed, rate, host_kept``.

    The prior is fitted by moments: the spread of the hosts' rates, less what
    chance alone gives, fixes how many documents the prior is worth.
    """
    hosts = stats.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n_docs"), F.sum(failed.cast("long")).alias("n_failed"))
    hosts = materialize(hosts, "hosts")
    total = hosts.agg(
        F.sum("n_docs").alias("docs"), F.sum("n_failed").alias("failed"), F.count("*").alias("hosts"),
        F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n_docs")).alias("squares"),
    ).first()
    docs, mean = total["docs"] or 0, (total["failed"] or 0) / max(1, total["docs"] or 0)
    chance = mean * (1 - mean)
    between = (total["squares"] or 0) / max(1, docs) - mean * mean - chance * max(0, total["hosts"] - 1) / max(1, docs)
    worth = min(1e6, max(1.0, chance / between - 1)) if between > 1e-12 else 1e6
    rate = (F.col("n_failed") + mean * worth) / (F.col("n_docs") + worth)
    return hosts.select("*", rate.alias("rate")).select("*", (F.col("rate") <= rules.max_host_rate).alias("host_kept"))


def join_verdicts(stats: DataFrame, hosts: DataFrame, host: str, rate: str, kept: str) -> DataFrame:
    """Every row of ``stats`` with its host's rate and whether it is kept, under the given names."""
    small = hosts.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    (own,) = unused(stats.withColumns({rate: F.lit(0), kept: F.lit(0)}), "_host_host")
    side = hosts.select("host", "rate", "host_kept").toDF(own, rate, kept)
    return stats.join(F.broadcast(side) if small else side, F.col(host).eqNullSafe(F.col(own)), "left").drop(own)


def quality_rules(docs: DataFrame, text: str = "text", host: str = "source", rules: QualityRules = QualityRules()) -> DataFrame:
    """``docs`` without its text, with the counts, ``base_failed``, the host's ``host_rate`` and ``kept``.

    Columns of ``docs`` that have one of these names are left out of the result.
    """
    made = {*_STATS, "base_failed", "kept", "host_rate"}
    carried = [c for c in docs.columns if c != text and c.lower() not in made]
    own, words, mark, rate, good = unused(docs, "_host", "_text", "_quality", "_rate", "_good")
    narrow = docs.select(*[F.col(f"`{c}`") for c in carried], F.col(f"`{host}`").alias(own), F.col(f"`{text}`").alias(words))
    stats = materialize(with_stats(narrow, words, rules, mark).drop(words), "quality")
    hosts = host_verdicts(stats, own, F.col(f"{mark}.base_failed"), rules)
    return join_verdicts(stats, hosts, own, rate, good).select(
        *[F.col(f"`{c}`") for c in carried], f"{mark}.*", F.col(rate).alias("host_rate"),
        (~F.col(f"{mark}.base_failed") & F.col(good)).alias("kept"),
    )


def keep_good(docs: DataFrame, text: str = "text", host: str = "source", rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns of ``docs``.

    The counts are computed once for the hosts and again while rows pass, so no text is shuffled or stored.
    """
    mark, key, rate, good = unused(docs, "_quality", "_host", "_rate", "_good")
    sides = docs.select(F.col(f"`{host}`").alias("_host"), F.col(f"`{text}`").alias("_text"))
    hosts = host_verdicts(with_stats(sides, "_text", rules, "_quality"), "_host", F.col("_quality.base_failed"), rules)
    marked = with_stats(docs.withColumn(key, F.col(f"`{host}`")), text, rules, mark)
    passed = join_verdicts(marked.filter(~F.col(f"{mark}.base_failed")), hosts, key, rate, good).filter(good)
    return passed.select(*[F.col(f"`{c}`") for c in docs.columns])
