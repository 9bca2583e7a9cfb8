"""Small helpers around tables: internal names, matching ids, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sievework.session import materialize

#: Stands for a missing id: it sorts after all others.
NO_ID = (1 << 63) - 1


def known_id(name: str) -> Column:
    """The id as a long; missing ids count as one document with the largest id."""
    return F.coalesce(F.col(f"`{name}`").cast("long"), F.lit(NO_ID))


def given_id(name: str) -> Column:
    """Undo :func:`known_id`."""
    return F.nullif(F.col(name), F.lit(NO_ID))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Each name with as many leading underscores as it needs not to clash with a column."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name = "_" + name
        have.add(name.lower())
        out.append(name)
    return out


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): a row (node, root) for each node that has an edge.

    Each round maps a node to the smallest node next to it and contracts the
    edges; with random ids (digests) the graph shrinks by a constant factor, so
    rounds grow with the logarithm.  Tables of a round are written, which also
    cuts the lineage.  Nothing goes to the driver but whether edges are left.
    """
    both = edges.select("a", "b").filter("a <> b")
    both = materialize(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    levels = []
    while not both.isEmpty():
        step = both.groupBy("a").agg(F.min("b").alias("near")).select(F.col("a").alias("node"), F.least("a", "near").alias("root"))
        step = materialize(step, "roots")
        levels.append(step)
        ends = both.join(step.toDF("a", "ra"), "a").join(step.toDF("b", "rb"), "b")
        both = materialize(ends.filter("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "edges")
    if not levels:
        return both.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = levels[-1]
    for step in reversed(levels[:-1]):
        found = materialize(
            step.join(found.toDF("root", "_further"), "root", "left").select("node", F.coalesce("_further", "root").alias("root")),
            "roots",
        )
    return found
