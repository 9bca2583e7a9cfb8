"""Secrets in texts: fixed formats, and formats inferred as probabilistic automata.

One pass over the texts finds the base spans (assignments to secret-like names, access
keys, long hexadecimal runs) and the candidates: runs of ``min_chars`` or more credential
characters, their parts between equals signs, and either without punctuation at its ends,
as far as they meet no base span.  The values of base spans are the labelled credentials.  For each kind a prefix tree of a bounded sample of them, by
character class, is folded into an automaton: states whose ends and next symbols have
statistically equal frequencies (Hoeffding bound) are merged.  A candidate is
accepted if some automaton gives it at least the likelihood per character that all but
``tail`` of that automaton's labelled values have.  Of accepted candidates that overlap
the one furthest above that (then the longer one) becomes a span of kind ``grammar``.

The sample is the ``sample`` values with the smallest hashes, so reruns agree; labelled
values beyond it are spans all the same.  Without labelled values nothing is added.

Defined cases: missing and empty texts have no spans; repeated rows are scanned each.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sievework.llm.bytesets import Texts, slices
from sievework.session import materialize

#: Fixed patterns of the base kinds.
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "grammar")
_HEX = np.isin(np.arange(256), list(b"0123456789abcdef"))
_DIGIT = np.isin(np.arange(256), list(b"0123456789"))
_LETTER = np.isin(np.arange(256), list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
_VALUE = _DIGIT | _LETTER | np.isin(np.arange(256), list(b"+/_.=-"))
_EDGE = "+/_.=-"
#: Scored values that a task remembers.
_VALUES_HELD = 100_000
#: Character classes of the automata.
_CLASSES = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+/", "_-", ".=")
_CLASS_OF = {c: i for i, group in enumerate(_CLASSES) for c in group}


@dataclass(frozen=True)
class ScanSettings:
    #: As short as the values of assignments.
    min_chars: int = 8
    #: Labelled values per kind from which an automaton is inferred.
    sample: int = 600
    #: Longer labelled values are spans, but no examples of a format: one would outweigh all others.
    longest: int = 256
    #: Confidence of the Hoeffding bound.
    alpha: float = 0.05
    tail: float = 0.02
    min_labelled: int = 8


def base_spans(text: str, hex_runs: list[tuple[int, int]]) -> list[tuple[int, int, str, str]]:
    """``(start, end, kind, value)`` in characters; hexadecimal runs come as character spans."""
    found = [(a, b, "hex", text[a:b]) for a, b in hex_runs]
    small = text.lower()
    if any(name in small for name in _NAMES):
        found += [(m.start(), m.end(), "assign", m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), m.end(), "access", m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def outside(runs: list[tuple[int, int]], known: list[tuple]) -> list[tuple[int, int]]:
    """The runs that meet no known span; both ascend by start, so one pass over the two is enough."""
    free, at, reach = [], 0, 0
    for start, end in runs:
        while at < len(known) and known[at][0] < end:
            reach = max(reach, known[at][1])
            at += 1
        if reach <= start:
            free.append((start, end))
    return free


def pieces(runs: list[tuple[int, int]], text: str, known: list[tuple], least: int) -> list[tuple[int, int]]:
    """The runs, their parts between equals signs, and both without punctuation at the ends, outside the known spans."""
    parts, found = [], set()
    for a, b in runs:
        for part in text[a:b].split("="):
            parts.append((a, a + len(part)))
            a += len(part) + 1
    for cut in (runs, parts):
        bare = []
        for a, b in cut:
            value = text[a:b]
            left = value.lstrip(_EDGE)
            bare.append((b - len(left), b - len(value) + len(value.rstrip(_EDGE)) if left else b))
        for some in (cut, bare):
            found.update(outside([(a, b) for a, b in some if b - a >= least], known))
    return sorted(found)


def apart(accepted: list[tuple[float, int, int]]) -> list[tuple[int, int]]:
    """Of ``(margin, start, end)`` the best that do not overlap."""
    kept: list[tuple[int, int]] = []
    for _, start, end in sorted(accepted, key=lambda x: (-x[0], x[1] - x[2], x[1])):
        at = bisect_left(kept, (start, end))
        if (at == 0 or kept[at - 1][1] <= start) and (at == len(kept) or end <= kept[at][0]):
            kept.insert(at, (start, end))
    return kept


def joined(spans: list[tuple]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind, *_ in spans)


_SPANS = "array<struct<start:bigint,end:bigint,kind:string,value:string>>"


def found_spans(docs: DataFrame, doc_id: str, text: str, s: ScanSettings) -> DataFrame:
    """``doc_id, base, candidates``: spans with their values, from one pass over the texts."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = Texts(part.column("text"))
                data = texts.data
                start, end = texts.runs(_HEX[data])
                long_ = end - start >= 32
                hexes = (start[long_], end[long_])
                start, end = texts.runs(_VALUE[data])
                long_ = end - start >= s.min_chars
                runs = (start[long_], end[long_])
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                base, more = [], []
                plain = part.column("text").to_pylist()
                for i, low in enumerate(texts.bounds[:-1]):
                    high, own = texts.bounds[i + 1], plain[i] or ""
                    spans = []
                    for a, b in (hexes, runs):
                        x, y = np.searchsorted(a, [low, high])
                        spans.append(list(zip((chars[a[x:y]] - chars[low]).tolist(), (chars[b[x:y]] - chars[low]).tolist())))
                    known = base_spans(own, spans[0])
                    free = pieces(spans[1], own, known, s.min_chars)
                    base.append([dict(zip(("start", "end", "kind", "value"), x)) for x in known])
                    more.append([{"start": a, "end": b, "kind": "grammar", "value": own[a:b]} for a, b in free])
                struct = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("value", pa.string())]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(base, struct), pa.array(more, struct)], ["doc_id", "base", "candidates"]
                )

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, base {_SPANS}, candidates {_SPANS}")


def symbols(value: str) -> list[int]:
    return [_CLASS_OF[c] for c in value]


class Automaton:
    """A probabilistic automaton inferred from labelled strings by merging prefix-tree states."""

    def __init__(self, strings: list[list[int]], alpha: float) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.passed: list[dict[int, int]] = [{}]
        self.ended: list[int] = [0]
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        for string in strings:
            at = 0
            for x in string:
                self.passed[at][x] = self.passed[at].get(x, 0) + 1
                if x not in self.next[at]:
                    self.next[at][x] = len(self.next)
                    self.next.append({})
                    self.passed.append({})
                    self.ended.append(0)
                at = self.next[at][x]
            self.ended[at] += 1
        self._merge()

    def _seen(self, state: int) -> int:
        return self.ended[state] + sum(self.passed[state].values())

    def _differ(self, f: int, n: int, g: int, m: int) -> bool:
        return bool(n and m) and abs(f / n - g / m) > self.bound * (n**-0.5 + m**-0.5)

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self._seen(a), self._seen(b)
            if self._differ(self.ended[a], n, self.ended[b], m):
                return False
            for x in self.passed[a].keys() | self.passed[b].keys():
                if self._differ(self.passed[a].get(x, 0), n, self.passed[b].get(x, 0), m):
                    return False
            todo += [(self.next[a][x], y) for x, y in self.next[b].items() if x in self.next[a]]
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below ``b`` to the states from ``a`` on."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.ended[a] += self.ended[b]
            for x, n in self.passed[b].items():
                self.passed[a][x] = self.passed[a].get(x, 0) + n
            for x, y in self.next[b].items():
                if x in self.next[a]:
                    todo.append((self.next[a][x], y))
                else:
                    self.next[a][x] = y

    def _merge(self) -> None:
        settled = [0]
        while True:
            edge = next(((r, x, y) for r in settled for x, y in sorted(self.next[r].items()) if y not in set(settled)), None)
            if edge is None:
                return
            parent, x, blue = edge
            same = next((r for r in settled if self._compatible(r, blue)), None)
            if same is None:
                settled.append(blue)
            else:
                self.next[parent][x] = same
                self._fold(same, blue)

    def likelihood(self, string: list[int]) -> float:
        """Mean log-likelihood of a symbol and the end; symbols that a state never met count as rare."""
        at, total = 0, 0.0
        for x in string:
            n = self._seen(at)
            total += math.log((self.passed[at].get(x, 0) + 1e-4) / (n + 1e-3))
            if x not in self.next[at]:
                return -math.inf
            at = self.next[at][x]
        total += math.log((self.ended[at] + 1e-4) / (self._seen(at) + 1e-3))
        return total / (len(string) + 1)


def infer_formats(found: DataFrame, s: ScanSettings) -> list[tuple[Automaton, float]]:
    """Automata with their thresholds, one per kind with enough distinct labelled values."""
    labelled = found.select(F.explode("base").alias("b")).select("b.kind", "b.value").distinct()
    formats = []
    for kind in KINDS[:-1]:
        rows = labelled.filter((F.col("kind") == kind) & (F.length("value") <= s.longest)).orderBy(F.xxhash64("value"), "value").limit(s.sample).collect()
        strings = [symbols(r["value"]) for r in rows if set(r["value"]) <= _CLASS_OF.keys()]
        if len(strings) >= s.min_labelled:
            made = Automaton(strings, s.alpha)
            scores = sorted(made.likelihood(x) for x in strings)
            formats.append((made, scores[int(s.tail * len(scores))]))
    return formats


def secret_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", settings: ScanSettings = ScanSettings()) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_grammar`` for every row of ``docs``."""
    found = materialize(found_spans(docs, doc_id, text, settings), "spans")
    formats = infer_formats(found, settings)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        margins: dict[str, float] = {}

        def margin(value: str) -> float:
            if value not in margins:
                if len(margins) > _VALUES_HELD:
                    margins.clear()
                string = symbols(value)
                margins[value] = max((f.likelihood(string) - least for f, least in formats), default=-math.inf)
            return margins[value]

        for batch in batches:
            rows = []
            for base, more in zip(batch["base"], batch["candidates"]):
                known = [(b["start"], b["end"], b["kind"]) for b in base]
                kinds = [k for _, _, k in known]
                scored = [(margin(c["value"]), c["start"], c["end"]) for c in more]
                added = [(a, b, "grammar") for a, b in apart([x for x in scored if x[0] >= 0])]
                spans = sorted(known + added, key=lambda x: (x[0], KINDS.index(x[2])))
                digest = hashlib.sha256(joined(known).encode()).hexdigest()
                rows.append((*(kinds.count(k) for k in KINDS[:-1]), digest, joined(spans), len(added)))
            made = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_grammar"])
            yield pd.concat([batch[["doc_id"]].reset_index(drop=True), made], axis=1)

    kind = docs.schema[doc_id].dataType.simpleString()
    return found.mapInPandas(
        run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_grammar long"
    )
