"""Records of quoted delimited text, read in byte ranges.

A quoted cell may hold line breaks, so a line does not say by itself whether it begins a
record.  What decides is whether the number of quotes before it is odd.  Spark's text
reader cuts files into byte ranges of whole lines; the first pass counts the quotes of
each range, a running sum over the ranges of a file says in which state each range
begins, and the second pass cuts every range into records from there.  A range hands on
at most two pieces of records, one that it finds open and one that it leaves open;
these are put together range by range.

This holds for text whose quotes stand at the borders of cells and are doubled inside
(RFC 4180).  Both passes look at every quote's neighbours, and text that breaks the rule
is reported instead of being cut wrongly.
"""

from __future__ import annotations

import csv
import io
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sievework.session import materialize, ship_package

_RETURN = 13


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value, file, start, block``: the lines as they stand, with the byte range that they come from."""
    lines = spark.read.option("lineSep", "\n").text(path)
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    return lines.select("value", *place).withColumn("block", F.xxhash64("file", "start"))


def may_break(spark: SparkSession, path: str, sep: str, quote: str) -> bool:
    """Whether some line has an odd number of quotes, or one that no cell's border explains."""
    value = F.col("value")
    odd = (F.length(value) - F.length(F.replace(value, F.lit(quote), F.lit("")))) % 2 == 1
    s, q = (f"\\x{ord(c):02x}" for c in (sep, quote))
    stray = value.rlike(f"[^{s}{q}]{q}[^{s}{q}\\r]")
    return not spark.read.option("lineSep", "\n").text(path).filter(odd | stray).isEmpty()


class _Marks:
    """The quotes of some lines that follow each other: where they are, and what stands beside them."""

    def __init__(self, lines: pa.Array, sep: int, quote: int) -> None:
        lines = lines.cast(pa.large_string())
        offsets = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + len(lines) + 1]
        data = lines.buffers()[2]
        data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
        self.offsets = offsets - offsets[0]
        at = np.flatnonzero(data == quote)
        line = np.searchsorted(self.offsets, at, "right") - 1
        self.per_line = np.bincount(line, minlength=len(lines))
        padded = np.concatenate([[sep], data, [sep]]).astype(np.uint8)
        first, last = at == self.offsets[line], at + 1 == self.offsets[line + 1]
        before, after = padded[at], padded[at + 2]
        ends = last | ((after == _RETURN) & (at + 2 == self.offsets[line + 1]))
        self.may_open = first | (before == sep) | (before == quote)
        self.may_close = ends | (after == sep) | (after == quote)
        # Carriage returns inside a line may only stand in quoted cells.
        returns = np.flatnonzero(data == _RETURN)
        of = np.searchsorted(self.offsets, returns, "right") - 1
        self.returns_at = np.searchsorted(at, returns[returns + 1 != self.offsets[of + 1]])

    def breaks_rule(self, quoted: int) -> bool:
        """Whether quotes stand where they cannot, if the first line begins inside a quoted cell (1) or not (0)."""
        opening = (np.arange(len(self.may_open)) + quoted) % 2 == 0
        wrong = np.where(opening, ~self.may_open, ~self.may_close)
        return bool(wrong.any() or ((self.returns_at + quoted) % 2 == 0).any())


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """Parts of batches of one byte range, and whether the range begins there."""
    last = None
    for batch in batches:
        block = batch.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1), len(block)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield int(block[a]), block[a] != last, batch.slice(a, b - a)
                last = block[a]


def _quote_counts(lines: DataFrame, sep: int, quote: int) -> DataFrame:
    """Per part of a byte range the number of its quotes, and whether it breaks the rule for either state at its beginning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        names = ["block", "file", "start", "quotes", "wrong0", "wrong1"]

        def out(x):
            return pa.RecordBatch.from_pydict({n: [v] for n, v in zip(names, x)}, schema)

        schema = pa.schema(list(zip(names, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()))))
        for block, begins, part in _blocks(batches):
            if begins:
                if held:
                    yield out(held)
                held = [block, part.column("file")[0].as_py(), part.column("start")[0].as_py(), 0, False, False]
            marks = _Marks(part.column("value"), sep, quote)
            for state in (0, 1):
                held[4 + state] |= marks.breaks_rule((held[3] + state) % 2)
            held[3] += int(marks.per_line.sum())
        if held:
            yield out(held)

    return lines.mapInArrow(run, "block long, file string, start long, quotes long, wrong0 boolean, wrong1 boolean")


def _cut(lines: DataFrame, states: dict[str, np.ndarray], sep: int, quote: int) -> DataFrame:
    """``file, start, kind, first, value``: whole records (0), the end of an open one (1), one left open (2)."""
    known, inside = states["known"], states["inside"]

    def has(sorted_: np.ndarray, value: int) -> bool:
        at = np.searchsorted(sorted_, value)
        return at < len(sorted_) and sorted_[at] == value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []  # lines of the record that is open
        where, quoted, head, opens_file = ("", 0), 0, False, False

        def out(records: list[tuple[int, bool, str]]) -> pa.RecordBatch:
            kind, first, value = zip(*records)
            n = len(records)
            return pa.RecordBatch.from_pydict(
                {"file": [where[0]] * n, "start": [where[1]] * n, "kind": pa.array(kind, pa.int32()), "first": list(first), "value": list(value)}
            )

        def rest() -> list[tuple[int, bool, str]]:
            return [(1 if head else 2, opens_file, "\n".join(held))] if held else []

        for block, begins, part in _blocks(batches):
            if begins:
                if held:
                    yield out(rest())
                if not has(known, block):
                    raise RuntimeError("The byte ranges of the file changed between two passes; read it again.")
                where = (part.column("file")[0].as_py(), part.column("start")[0].as_py())
                quoted = head = int(has(inside, block))
                held, opens_file = [], where[1] == 0
            records = []
            marks = _Marks(part.column("value"), sep, quote)
            ends = (quoted + np.cumsum(marks.per_line)) % 2
            for text, state in zip(part.column("value").to_pylist(), ends.tolist()):
                held.append(text)
                if not state:
                    records.append((1 if head else 0, opens_file, "\n".join(held)))
                    held, head, opens_file = [], False, False
            quoted = int(ends[-1])
            if records:
                yield out(records)
        if held:
            yield out(rest())

    return lines.mapInArrow(run, "file string, start long, kind int, first boolean, value string")


def records(spark: SparkSession, path: str, sep: str = ",", quote: str = '"') -> DataFrame | None:
    """``file, first, value``: the records of the files and whether each is its file's first; None if quotes break the rule."""
    lines = text_lines(ship_package(spark), path)
    counts = materialize(_quote_counts(lines, ord(sep), ord(quote)), "record-quotes")
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    states = counts.withColumn("inside", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2 == 1)
    states = states.select("block", "inside", F.when(F.col("inside"), F.col("wrong1")).otherwise(F.col("wrong0")).alias("wrong"))
    # A row per byte range: some bytes for each hundred megabytes.
    found = states.toArrow()
    if any(found.column("wrong").to_pylist()):
        return None
    block, inside = found.column("block").to_numpy(), found.column("inside").to_numpy()
    cut = materialize(_cut(lines, {"known": np.sort(block), "inside": np.sort(block[inside])}, ord(sep), ord(quote)), "records")
    pieces = cut.filter("kind > 0")
    along = Window.partitionBy("file").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pieces = pieces.withColumn("nth", F.sum((F.col("kind") == 2).cast("long")).over(along))
    joined = pieces.groupBy("file", "nth").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("start", "kind", "value")))["value"], "\n").alias("value"), F.max("first").alias("first")
    )
    columns = ["file", "first", "value"]
    whole = cut.filter("kind = 0").select(columns).unionByName(joined.select(columns))
    value = F.regexp_replace("value", "\\r\\z", "")
    return whole.withColumn("value", F.when(F.col("first"), F.ltrim(value, F.lit("\ufeff"))).otherwise(value))


def column_names(found: DataFrame, sep: str, quote: str, header: bool) -> list[str]:
    """Names as Spark gives them: unnamed cells by their place, repeated names with their place."""
    first = found.filter("first").orderBy("file").select("value").first()
    cells = next(csv.reader(io.StringIO(first[0], newline=""), delimiter=sep, quotechar=quote), []) if first else []
    seen = Counter(c.lower() for c in cells)
    return [f"_c{i}" if not header or not c else f"{c}{i}" if seen[c.lower()] > 1 else c for i, c in enumerate(cells)]
