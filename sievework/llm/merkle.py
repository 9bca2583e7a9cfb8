"""A manifest of a table as Merkle trees: a tree per group, and one over the groups' roots.

Every row is a leaf: the SHA-256 of its fields.  Within a group leaves are numbered along
the order key.  At every level a node meets its siblings by an equijoin of the level with
itself on the computed sibling index (index XOR 1 for binary trees, the other slots of the
run otherwise), so no window and no group gathers a tree; the rows of slot zero then emit
their parents.  A level is written before the next, which cuts the lineage; ``fan_out``
times fewer rows each, all levels together are about as long as the table.  Proofs are put together on the
way back down, each node prefixing its own siblings to its parent's proof.

A digest's inputs are digests as lower-case hex text; a field is ``-`` if missing, else its
number of UTF-8 bytes, ``:`` and its value as text.

Defined cases: rows without an order key come last in their group; rows that tie are ordered by
leaf (equal leaves are interchangeable); missing groups are one group, before all others;
the last run of a level may be shorter, and a run of one is hashed alone; a group of one
leaf has that leaf as its root; an empty table gives no rows; other columns, whatever their
names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sievework.functions.ordering import ROWS_PER_RANGE, with_position
from sievework.session import materialize

#: Leaves are numbered in so many ranges at least, of so many rows at least.
_RANGES, _RANGE_ROWS = 256, 10_000
#: Levels whose proofs are put together in one plan.
_LEVELS_A_STEP = 6


def encoded(value: Column) -> Column:
    """A field as text: ``-`` or ``bytes:value``."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def hexed(value: Column) -> Column:
    return F.lower(F.hex(value))


def _run_digest(children: Column) -> Column:
    return digest(F.array_join(F.transform(children, hexed), ""))


def _with_siblings(nodes: DataFrame, fan_out: int) -> DataFrame:
    """``tree, index, left, digest, slot, others``: the digests of the run's other nodes by slot."""
    slot = F.col("index") % fan_out
    found = nodes.withColumn("slot", slot.cast("int"))
    if fan_out == 2:
        at = [F.col("index").bitwiseXOR(F.lit(1))]
    else:
        at = [F.col("index") - slot + (slot + shift) % fan_out for shift in range(1, fan_out)]
    cells = []
    for k, index in enumerate(at):
        other = nodes.select("tree", F.col("index").alias("_at"), F.col("digest").alias(f"_other{k}"))
        found = found.withColumn("_at", index).join(other, ["tree", "_at"], "left").drop("_at")
        place = (F.col("slot") + (k + 1)) % fan_out
        cells.append(F.when(F.col(f"_other{k}").isNotNull(), F.struct(place.alias("slot"), F.col(f"_other{k}").alias("digest"))))
    others = F.array_sort(F.array_compact(F.array(*cells)))["digest"]
    return found.select("tree", "index", "left", "digest", "slot", others.alias("others"))


def climb(nodes: DataFrame, longest: int, fan_out: int = 2) -> tuple[list[DataFrame], DataFrame]:
    """The levels of all trees at once, and ``tree, digest`` of their roots.

    ``nodes`` holds ``tree, index, left, digest``, ``left`` being the number of the tree's nodes, at most ``longest``.
    """
    levels, tops = [], nodes.filter("left = 1")
    while longest > 1:
        level = materialize(_with_siblings(nodes.filter("left > 1"), fan_out), "merkle-level")
        levels.append(level)
        parent = _run_digest(F.concat(F.array("digest"), F.col("others")))
        nodes = level.filter("slot = 0").select(
            "tree", (F.col("index") / fan_out).cast("long").alias("index"),
            F.ceil(F.col("left") / fan_out).cast("long").alias("left"), parent.alias("digest"),
        )
        tops = tops.unionByName(nodes.filter("left = 1"))
        longest = -(-longest // fan_out)
    return levels, tops.select("tree", "digest")


def paths(levels: list[DataFrame], fan_out: int = 2) -> DataFrame | None:
    """``tree, index, path`` of the leaves: own slot and siblings at each level, from the leaf up."""
    below = None
    for depth, level in enumerate(reversed(levels)):
        own = level.withColumn("_up", (F.col("index") / fan_out).cast("long"))
        step = F.array(F.struct("slot", "others"))
        if below is None:
            below = own.select("tree", "index", step.alias("path"))
        else:
            above = below.select("tree", F.col("index").alias("_up"), F.col("path").alias("_rest"))
            path = F.when(F.col("_rest").isNull(), step).otherwise(F.concat(step, "_rest"))
            below = own.join(above, ["tree", "_up"], "left").select("tree", "index", path.alias("path"))
        if depth % _LEVELS_A_STEP == _LEVELS_A_STEP - 1 and depth < len(levels) - 1:
            below = materialize(below, "merkle-paths")
    return below


_PATH = "array<struct<slot:int,others:array<binary>>>"


def _longest(nodes: DataFrame) -> int:
    return nodes.agg(F.max("left")).first()[0] or 0


def _and_paths(nodes: DataFrame, levels: list[DataFrame], fan_out: int) -> DataFrame:
    found = paths(levels, fan_out)
    if found is None:
        return nodes.withColumn("path", F.array().cast(_PATH))
    joined = nodes.join(found, ["tree", "index"], "left")
    return joined.withColumn("path", F.coalesce("path", F.array().cast(_PATH)))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    def up(now: Column, step: Column) -> Column:
        before = F.slice(step["others"], F.lit(1), step["slot"])
        after = F.slice(step["others"], step["slot"] + 1, F.size(step["others"]))
        return _run_digest(F.concat(before, F.array(now), after))

    return F.aggregate(path, leaf, up)


def proof_digest(path: Column) -> Column:
    """H of all siblings, level by level."""
    return hexed(_run_digest(F.flatten(F.transform(path, lambda step: step["others"]))))


def merkle_manifest(
    rows: DataFrame,
    fields: Sequence[str],
    order: str,
    group: str,
    altered: Mapping[str, Column] | None = None,
    fan_out: int = 2,
) -> DataFrame:
    """A row per row of ``rows``: ``key`` (its order key), ``leaf, subroot, root`` (hex), ``path`` and ``altered``.

    ``altered`` is the digest of the row with some fields replaced, else of the row as it is: what a later reader
    of a changed table computes.  :func:`folded` checks it against the root along ``path``.
    """
    def leaf(values: Mapping[str, Column]) -> Column:
        return digest(*[encoded(values.get(f, F.col(f"`{f}`"))) for f in fields])

    spark, name = rows.sparkSession, F.col(f"`{group}`").cast("string")
    leaves = rows.select(
        F.col(f"`{order}`").alias("key"), name.alias("name"), encoded(name).alias("tree"), leaf({}).alias("digest"),
        (leaf(altered) if altered else F.lit(None).cast("binary")).alias("altered"), F.monotonically_increasing_id().alias("row"),
    )
    leaves = materialize(leaves.withColumn("altered", F.coalesce("altered", "digest")), "merkle-leaves")
    known = F.col("name").isNotNull().cast("int")
    number = leaves.count()
    placed = with_position(
        leaves.withColumn("known", known), ["known", "name", "key", "digest", "row"], "position",
        rows=number, rows_per_range=min(ROWS_PER_RANGE, max(_RANGE_ROWS, number // _RANGES)),
    )
    placed = materialize(placed.select("key", "tree", "position", "digest", "altered", "name", "known"), "merkle-placed")
    # A row per group, in the groups' order.
    groups = placed.groupBy("tree").agg(F.first("name").alias("name"), F.first("known").alias("known"), F.min("position").alias("first"), F.count("*").alias("left"))
    groups = materialize(with_position(groups, ["known", "name"], "nth").select("tree", "nth", "first", "left"), "merkle-groups")
    nodes = placed.join(groups, "tree").select("key", "tree", (F.col("position") - F.col("first")).alias("index"), "left", "digest", "altered")
    nodes = materialize(nodes, "merkle-indexed")
    levels, tops = climb(nodes.select("tree", "index", "left", "digest"), _longest(groups), fan_out)
    trees = groups.count()
    subroots = materialize(
        tops.withColumnRenamed("tree", "group").join(groups.select(F.col("tree").alias("group"), F.col("nth").alias("index")), "group")
        .select("group", F.lit("").alias("tree"), "index", F.lit(trees).cast("long").alias("left"), "digest"),
        "merkle-subroots",
    )
    upper, top = climb(subroots.select("tree", "index", "left", "digest"), trees, fan_out)
    found = top.first()
    if found is None:
        return spark.createDataFrame([], f"leaf string, subroot string, root string, altered binary, path {_PATH}").select(
            F.lit(None).cast(rows.schema[order].dataType).alias("key"), "*"
        )
    of_group = _and_paths(subroots, upper, fan_out).select(F.col("group").alias("tree"), hexed(F.col("digest")).alias("subroot"), F.col("path").alias("_upper"))
    whole = _and_paths(nodes, levels, fan_out).join(materialize(of_group, "merkle-group-paths"), "tree")
    root = bytes(found["digest"]).hex()
    return whole.select(
        "key", hexed(F.col("digest")).alias("leaf"), "subroot", F.lit(root).alias("root"), "altered", F.concat("path", "_upper").alias("path")
    )
