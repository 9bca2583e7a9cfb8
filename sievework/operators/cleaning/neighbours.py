"""Exact k-nearest-neighbour imputation without comparing every row with every other.

Distance is Euclidean over the numeric columns both rows have, scaled up for
the ones they lack.  For one target column:

* rows equal in all numeric columns are combined first, with their number, so a
  large group of copies is one donor (or one gap row);
* donors are cut into blocks of a k-d tree whose splits come from a sample.  The target
  column cuts nothing, since no gap row has it;
* a gap row searches its own block first; the k-th nearest found there bounds its reach.
  Then it visits other blocks in the order of their boxes' distance, 4, 16, 64, ... of them
  a round, and every round shrinks the reach; it is settled once the next box is beyond
  it.  The boxes within reach are found by descending the tree;
* inside a block the same is done once more, with a small tree of leaves in memory.
  No donor within reach is left out, so the result is exact;
* blocks with many gap rows are searched in several tasks.

Equal distances are resolved by the smaller donor value.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from sievework.functions.columns import as_double, numeric_columns, quoted
from sievework.functions.frequencies import attach
from sievework.session import materialize, remove_step, write_step

#: Donors that shape the tree: so many at least, and some for each block.
_SAMPLE = 50_000
_SAMPLE_PER_BLOCK = 64
#: Donors that one task holds, and gap vectors it searches for.
_BLOCK_ROWS = 50_000
_GAPS_PER_TASK = 4_000
#: Leaves in a block are no larger than this, whatever is asked for.
_LEAF_ROWS = 500
_COLUMNS_AT_ONCE = 4
#: Numbers in one array: of distances, and of bounds of boxes.
_CHUNK_CELLS = 1 << 17
_BOUND_CELLS = 1 << 20
#: Candidates of one round that are held before they are cut to k.
_HELD = 1 << 18
#: Bounds of boxes and distances are rounded differently.
_SLACK = 1 + 1e-9


def neighbour_impute(df: DataFrame, k: int = 5, leaf_rows: int = 20_000) -> DataFrame:
    """Fill the gaps of all numeric columns with the mean of the k nearest donors."""
    names = numeric_columns(df)
    vector = df.select([as_double(df, c).alias(f"x{i}") for i, c in enumerate(names)])
    xs = vector.columns
    row = df.agg(
        *[F.count_if(quoted(c).isNull()).alias(f"n{i}") for i, c in enumerate(names)],
        *[F.avg(as_double(df, c)).alias(f"m{i}") for i, c in enumerate(names)],
    ).first()
    gaps = [i for i in range(len(names)) if row[f"n{i}"] > 0 and row[f"m{i}"] is not None]
    if not gaps:
        return df
    # Distinct vectors with their number; everything below works on these.
    distinct = materialize(vector.groupBy(*xs).agg(F.count(F.lit(1)).alias("w")), "vectors")
    any_gap = F.lit(False)
    for i in gaps:
        any_gap = any_gap | F.col(f"x{i}").isNull()
    # Short numbers for the gap vectors; written, so that they stay.
    fills = asking = materialize(distinct.filter(any_gap).withColumn("q", F.monotonically_increasing_id()), "gaps")
    # Columns do not wait for each other's rounds: their jobs share the executors.
    with ThreadPoolExecutor(_COLUMNS_AT_ONCE) as pool:
        means = list(pool.map(lambda i: _search(distinct, asking.filter(F.col(f"x{i}").isNull()), xs, i, k, leaf_rows), gaps))
    for i, found in zip(gaps, means):
        fills = fills.join(found, "q", "left").withColumn(
            f"f{i}", F.when(F.col(f"x{i}").isNull(), F.coalesce(F.col("mean"), F.lit(row[f"m{i}"])))
        ).drop("mean")
    lookup = fills.select(
        _key(xs).alias("key"), F.struct(*[F.col(f"f{i}") for i in gaps]).alias("value"), F.col("w").alias("n")
    )

    here = [as_double(df, c).alias(f"x{i}") for i, c in enumerate(names)]
    missing = F.lit(False)
    for i in gaps:
        missing = missing | quoted(names[i]).isNull()
    keyed = df.withColumn("__q", F.when(missing, F.to_json(F.struct(*here), {"ignoreNullFields": "false"})))
    filled = attach(keyed, "__q", lookup, "__fill")
    new = {names[i]: F.coalesce(as_double(df, names[i]), F.col(f"__fill.f{i}")) for i in gaps}
    return filled.select([new[c].alias(c) if c in new else quoted(c) for c in df.columns])


def _key(xs: list[str]):
    return F.to_json(F.struct(*xs), {"ignoreNullFields": "false"})


def _search(
    distinct: DataFrame, asking: DataFrame, xs: list[str], target: int, k: int, leaf_rows: int
) -> DataFrame:
    """(q, mean): the mean target value of the k nearest donors of each gap vector."""
    donors = distinct.filter(F.col(f"x{target}").isNotNull())
    tree, crowded = _plan(donors, xs, target)
    if crowded:  # of donors that differ in nothing but the target, the smallest values are nearest
        others = [x for i, x in enumerate(xs) if i != target]
        nth = F.row_number().over(Window.partitionBy(*others).orderBy(f"x{target}"))
        donors = materialize(donors.withColumn("nth", nth).filter(F.col("nth") <= k).drop("nth"), "smallest")
        tree, _ = _plan(donors, xs, target)
    unbounded = F.lit(math.inf)
    if len(tree) == 1:
        here = F.lit(0)
        alone = asking.select("q", *xs, here.alias("block"), unbounded.alias("reach"))
        return _means(_nearest(donors.withColumn("block", here), alone, xs, target, k, leaf_rows), k)
    spark = distinct.sparkSession
    block_of = _block_udf(tree)(F.struct(*xs))
    donors, placed = write_step(donors.withColumn("block", block_of), "donors")
    boxes = _node_boxes(tree, _boxes(donors, xs))
    open_, opened = write_step(asking.select("q", *xs, block_of.alias("block")), "asking")
    found = _nearest(donors, open_.withColumn("reach", unbounded), xs, target, k, leaf_rows)
    best, written = write_step(_kept(found, k), "near")
    seen, count = 0, 4
    while True:  # rounds grow with the logarithm of the blocks
        reach = best.groupBy("q").agg(F.when(F.sum("w") >= k, F.max("d")).alias("found"))
        within = F.coalesce("found", unbounded)
        more = _visit_udf(tree, boxes, seen, count)(F.struct(*xs), within, "block")
        visits = open_.join(reach, "q", "left").select("q", *xs, "block", within.alias("reach"), more.alias("visits"))
        visits, round_ = write_step(visits.filter(F.size("visits") > 0), "visits")
        sent = visits.select("q", *xs, F.explode("visits").alias("block"), "reach")
        found = _nearest(donors, sent, xs, target, k, leaf_rows)
        remove_step(spark, opened)
        if found is None:
            remove_step(spark, round_)
            remove_step(spark, placed)
            break
        best, newer = write_step(_kept(best.unionByName(found), k), "near")
        remove_step(spark, written)
        open_, opened, written = visits.drop("reach", "visits"), round_, newer
        seen, count = seen + count, count * 4
    return _means(best, k)


def _plan(donors: DataFrame, xs: list[str], target: int) -> tuple[list[tuple], bool]:
    """The tree of blocks from a sample, and whether some block is too large for want of a split."""
    total = donors.count()
    share = min(1.0, max(_SAMPLE, _SAMPLE_PER_BLOCK * total / _BLOCK_ROWS) / max(1, total))
    sample = donors.select(*xs).sample(share, seed=5).toPandas().to_numpy(dtype=float)
    most = _BLOCK_ROWS * len(sample) / max(1, total)
    tree = _grow(sample, most, target)
    sizes = np.bincount(_places(tree, sample), minlength=1) if len(sample) else np.zeros(1)
    return tree, bool(sizes.max() > most + 1)


def _kept(near: DataFrame, k: int) -> DataFrame:
    """The k nearest of each gap vector, copies counted; ``d`` of the last is its reach."""
    upto = Window.partitionBy("q").orderBy("d", "v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return near.withColumn("upto", F.sum("w").over(upto)).filter(F.col("upto") - F.col("w") < k).drop("upto")


def _means(near: DataFrame, k: int) -> DataFrame:
    # At most k candidates per visited leaf remain for each gap vector.
    upto = Window.partitionBy("q").orderBy("d", "v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    take = F.greatest(F.lit(0), F.least(F.col("w"), F.lit(k) - (F.col("upto") - F.col("w"))))
    return (
        near.withColumn("upto", F.sum("w").over(upto))
        .withColumn("take", take)
        .groupBy("q")
        .agg((F.sum(F.col("v") * F.col("take")) / F.sum("take")).alias("mean"))
    )


def _nearest(
    donors: DataFrame, asking: DataFrame, xs: list[str], target: int, k: int, leaf_rows: int
) -> DataFrame | None:
    """(q, d, v, w): the k nearest donors within its reach of each gap vector in the block it is sent to; None if none is sent."""
    sizes = {r["block"]: r["n"] for r in asking.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    busy = {block: math.ceil(n / _GAPS_PER_TASK) for block, n in sizes.items() if n > _GAPS_PER_TASK}
    tasks = F.lit(1)
    if busy:
        pairs = [v for block, n in busy.items() for v in (F.lit(block), F.lit(n))]
        tasks = F.coalesce(F.element_at(F.create_map(*pairs), F.col("block")), F.lit(1))
    left = asking.select("q", "reach", "block", *xs).withColumn("part", F.pmod(F.hash("q"), tasks))
    right = donors.select("block", "w", *xs).withColumn("part", F.explode(F.sequence(F.lit(0), tasks - 1)))

    def search(ask: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        return _top_k(ask, have, xs, target, k, leaf_rows)

    return (
        left.groupBy("block", "part")
        .cogroup(right.groupBy("block", "part"))
        .applyInPandas(search, "q long, d double, v double, w long")
    )


def _top_k(ask: pd.DataFrame, have: pd.DataFrame, xs: list[str], target: int, k: int, leaf_rows: int) -> pd.DataFrame:
    if ask.empty or have.empty:
        return pd.DataFrame({"q": [], "d": [], "v": [], "w": []}).astype({"q": "int64", "w": "int64"})
    queries = ask[xs].to_numpy(dtype=float)
    reach = ask["reach"].to_numpy(dtype=float)
    points = have[xs].to_numpy(dtype=float)
    weight = np.minimum(have["w"].to_numpy(), k)
    most = max(1, min(leaf_rows, _LEAF_ROWS))
    tree = _grow(points, most, target)
    leaf = _places(tree, points)
    members = np.split(np.argsort(leaf, kind="stable"), np.cumsum(np.bincount(leaf))[:-1])
    # Donors that no split parts differ in the target only: the k smallest come first.
    members = [m if len(m) <= most else m[np.argsort(points[m, target], kind="stable")[:k]] for m in members]
    boxes = _bounds_of(points, members)
    near = []
    step = max(1, _BOUND_CELLS // len(members))
    for start in range(0, len(queries), step):
        some = slice(start, start + step)
        owner, d, pick = _in_block(queries[some], reach[some].copy(), points, weight, members, boxes, target, k)
        near.append((owner + start, d, pick))
    owner, d, pick = (np.concatenate(parts) for parts in zip(*near))
    return pd.DataFrame({"q": ask["q"].to_numpy()[owner], "d": d, "v": points[pick, target], "w": weight[pick]})


def _in_block(queries, reach, points, weight, members, boxes, target, k):
    """(query, distance, donor) of the k nearest within reach: leaves nearest first, 1, 2, 4, ... of them a round."""
    bounds = np.column_stack([_bound(queries, *(edge[i] for edge in boxes)) for i in range(len(members))])
    order = np.argsort(bounds, axis=1, kind="stable")
    bounds = np.take_along_axis(bounds, order, axis=1)
    best = (np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=np.int64))

    def nearest(parts):
        return _first(*(np.concatenate(p) for p in zip(*parts)), points[:, target], weight, k)

    seen, count = 0, 1
    while seen < len(members):
        ahead = bounds[:, seen : seen + count]
        rows, at = np.nonzero((ahead <= reach[:, None] * _SLACK) & np.isfinite(ahead))
        if not len(rows):
            break
        leaf = order[rows, seen + at]
        by_leaf = np.argsort(leaf, kind="stable")
        rows, leaf = rows[by_leaf], leaf[by_leaf]
        found, held = [best], 0
        edges = np.flatnonzero(np.diff(leaf, prepend=-1))
        for first, last in zip(edges, [*edges[1:], len(rows)]):
            inside = members[leaf[first]]
            step = max(1, _CHUNK_CELLS // len(inside))
            for start in range(first, last, step):
                asked = rows[start : min(last, start + step)]
                d = _distances(queries[asked], points[inside])
                edge = reach[asked]
                if len(inside) > k:
                    edge = np.minimum(edge, np.partition(d, k - 1, axis=1)[:, k - 1])
                r, c = np.nonzero((d <= edge[:, None]) & np.isfinite(d))
                found.append((asked[r], d[r, c], inside[c]))
                held += len(r)
                if held > _HELD:  # many equal distances, or many leaves in reach
                    found, held = [nearest(found)[0]], 0
        best, total = nearest(found)
        full, last = np.unique(best[0][::-1], return_index=True)
        last = len(best[0]) - 1 - last
        enough = total[last] >= k
        reach[full[enough]] = np.minimum(reach[full[enough]], best[1][last[enough]])
        seen, count = seen + count, count * 2
    return best


def _first(owner, d, pick, value, weight, k):
    """The k nearest of each owner, copies counted, and the copies up to each."""
    order = np.lexsort((value[pick], d, owner))
    owner, d, pick = owner[order], d[order], pick[order]
    copies = np.cumsum(weight[pick])
    heads = np.flatnonzero(np.diff(owner, prepend=-1))
    before = np.repeat(copies[heads] - weight[pick[heads]], np.diff([*heads, len(owner)]))
    upto = copies - before
    keep = upto - weight[pick] < k
    return (owner[keep], d[keep], pick[keep]), upto[keep]


def _distances(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Every query to every point over the columns that both have; infinite without any."""
    total = np.zeros((len(queries), len(points)))
    common = 0
    for x, y in zip(queries.T, points.T):
        if np.isnan(x).all() or np.isnan(y).all():
            continue
        gap = np.subtract.outer(x, y)
        if np.isfinite(x).all() and np.isfinite(y).all():
            common = common + 1
        else:
            both = ~np.isnan(gap)
            gap[~both] = 0.0
            common = common + both
        gap *= gap
        total += gap
    with np.errstate(divide="ignore", invalid="ignore"):
        distance = np.sqrt(np.divide(queries.shape[1], common) * total)
    return np.where(common == 0, np.inf, distance) if np.min(common) == 0 else distance


def _grow(points: np.ndarray, most: float, target: int) -> list[tuple]:
    """Splits as (column, threshold, left, right) down to ``most`` points; a leaf is (-1, leaf number, 0, 0)."""
    nodes: list[tuple] = [()]
    leaves = 0
    stack = [(0, np.arange(len(points)))]
    while stack:
        at, rows = stack.pop()
        split = _best_split(points[rows], target) if len(rows) > max(1, most) else None
        if split is None:
            nodes[at] = (-1, leaves, 0, 0)
            leaves += 1
            continue
        column, threshold = split
        left = np.isnan(points[rows, column]) | (points[rows, column] <= threshold)
        nodes[at] = (column, threshold, len(nodes), len(nodes) + 1)
        stack += [(len(nodes), rows[left]), (len(nodes) + 1, rows[~left])]
        nodes += [(), ()]
    return nodes


def _best_split(rows: np.ndarray, target: int) -> tuple[int, float] | None:
    """The widest column but the target at its median, such that both halves get rows; those that lack it come off first."""
    widest, column, known = 0.0, -1, None
    partly = None
    for c in range(rows.shape[1]):
        lacking = np.isnan(rows[:, c])
        if c == target or lacking.all():
            continue
        if lacking.any():
            partly = c if partly is None else partly
        some = rows[~lacking, c]
        span = float(some.max() - some.min())
        if span > widest:
            widest, column, known = span, c, some
    if column < 0:
        return None if partly is None else (partly, -math.inf)
    if len(known) < len(rows):
        return column, -math.inf
    middle = float(np.median(known))
    return column, middle if middle < known.max() else float(known[known < middle].max())


def _places(tree: list[tuple], rows: np.ndarray) -> np.ndarray:
    """The number of the leaf that each row falls into; missing goes left."""
    out = np.zeros(len(rows), dtype=np.int32)
    stack = [(0, np.arange(len(rows)))]
    while stack:
        node, members = stack.pop()
        column, threshold, left, right = tree[node]
        if column < 0:
            out[members] = threshold
        elif len(members):
            x = rows[members, column]
            low = np.isnan(x) | (x <= threshold)
            stack += [(left, members[low]), (right, members[~low])]
    return out


def _block_udf(tree: list[tuple]):
    @F.pandas_udf("int")
    def block(vectors: pd.DataFrame) -> pd.Series:
        return pd.Series(_places(tree, vectors.to_numpy(dtype=float)))

    return block


def _boxes(donors: DataFrame, xs: list[str]) -> dict[int, tuple]:
    """Per block: lower and upper bounds, infinite where some donor lacks the column, and the columns that any has."""
    edges = []
    for x in xs:
        whole = F.count(x) == F.count(F.lit(1))
        edges.append(F.when(whole, F.min(x)).otherwise(F.lit(float("-inf"))))
        edges.append(F.when(whole, F.max(x)).otherwise(F.lit(float("inf"))))
        edges.append(F.count(x) > 0)
    rows = donors.groupBy("block").agg(*[e.alias(f"e{i}") for i, e in enumerate(edges)]).collect()
    return {r["block"]: tuple(np.array(r[1 + i :: 3]) for i in range(3)) for r in rows}


def _bounds_of(points: np.ndarray, members: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`_boxes`, for rows at hand: one row per group."""
    low, high, present = [], [], []
    for rows in members:
        some = points[rows]
        lacking = np.isnan(some).any(axis=0)
        low.append(np.where(lacking, -np.inf, some.min(axis=0)))
        high.append(np.where(lacking, np.inf, some.max(axis=0)))
        present.append(~np.isnan(some).all(axis=0))
    return np.array(low), np.array(high), np.array(present)


def _node_boxes(tree: list[tuple], boxes: dict[int, tuple]) -> list[tuple]:
    """Boxes of all nodes: a split's box holds both halves; None without donors."""
    found: list = [None] * len(tree)
    for at in range(len(tree) - 1, -1, -1):  # halves come after their split
        column, number, left, right = tree[at]
        if column < 0:
            found[at] = boxes.get(number)
            continue
        halves = [h for h in (found[left], found[right]) if h is not None]
        if halves:
            low, high, present = zip(*halves)
            found[at] = np.minimum.reduce(low), np.maximum.reduce(high), np.logical_or.reduce(present)
    return found


def _bound(queries: np.ndarray, low: np.ndarray, high: np.ndarray, present: np.ndarray) -> np.ndarray:
    """No donor in the box is nearer to a query than this; infinite without a common column."""
    outside = np.maximum(0.0, np.maximum(low - queries, queries - high))
    outside[np.isnan(outside)] = 0.0
    have = (~np.isnan(queries) & present).sum(axis=1)
    least = np.sqrt(queries.shape[1] / np.maximum(1, have) * (outside * outside).sum(axis=1))
    return np.where(have > 0, least, np.inf)


def _visit_udf(tree: list[tuple], boxes: list[tuple], seen: int, count: int):
    """The next ``count`` blocks after ``seen`` ones, nearest boxes first, as far as they are within reach."""
    step = max(1, _BOUND_CELLS // len(tree))

    @F.pandas_udf("array<int>")
    def visit(vectors: pd.DataFrame, reach: pd.Series, own: pd.Series) -> pd.Series:
        points, limits, homes = vectors.to_numpy(dtype=float), reach.to_numpy() * _SLACK, own.to_numpy()
        lists: list = []
        for start in range(0, len(points), step):
            some, limit, home = (a[start : start + step] for a in (points, limits, homes))
            parts = [(np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=np.int32))]
            stack = [(0, np.arange(len(some)))]
            while stack:
                node, members = stack.pop()
                if boxes[node] is None or not len(members):
                    continue
                least = _bound(some[members], *boxes[node])
                close = (least <= limit[members]) & np.isfinite(least)
                members, least = members[close], least[close]
                column, number, left, right = tree[node]
                if column >= 0:
                    stack += [(left, members), (right, members)]
                    continue
                away = home[members] != number
                members, least = members[away], least[away]
                parts.append((members, least, np.full(len(members), number, dtype=np.int32)))
            owner, least, block = (np.concatenate(p) for p in zip(*parts))
            order = np.lexsort((block, least, owner))
            block = block[order]
            ends = np.cumsum(np.bincount(owner, minlength=len(some)))
            starts = np.concatenate([[0], ends[:-1]])
            lists += [block[min(a + seen, b) : min(a + seen + count, b)] for a, b in zip(starts, ends)]
        return pd.Series(lists, dtype=object)

    return visit
