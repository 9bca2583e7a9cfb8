"""Mix sources to target weights by entropy balancing.

Every document gets a rate, how often it enters the mix.  Among all rates whose
words meet the target of each source, the chosen ones differ least (in relative
entropy) from one copy each, with no rate above ``most_copies``.  Such rates are
exponential in the size: ``min(most_copies, exp(lambda * size))`` with one
multiplier for each source, which the convex dual gives.  Newton iterations solve
it for all sources at once; an iteration is one aggregation over distinct
(source, size) pairs, and a step that leaves the bracket is halved.

Rates become whole copies in buckets of about ``bucket`` documents of a source:
from long to short documents each takes the number of copies, one of the two next
to its rate, that leaves the smallest error in words so far, so a bucket ends
within about half its shortest documents' words of its share.  Hot sources are
many buckets.  Only DataFrame and SQL functions are used, and reruns agree.

Defined cases: a missing text has no words; a missing source is a source of its
own, last in order; documents without words take none; repeated rows count each;
if no document has words, nothing is taken.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from sievework.llm.tables import known_id, unused
from sievework.session import materialize

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixSettings:
    #: Weights of the sources in order of code points, repeating.
    weights: Sequence[float] = (5, 2, 1)
    most_copies: int = 3
    bucket: int = 512
    tolerance: float = 1e-6
    most_rounds: int = 60


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, s: MixSettings) -> DataFrame:
    """``source, source_size, target``: shares of all words by weight, at most ``most_copies`` times a source's own.

    What a source cannot take is shared among the others by weight, again until
    none is above: sources fill in order of their own words over weight, so the
    level is found with running sums instead of rounds.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    places = [F.when(F.col("_place") % len(s.weights) == i, F.lit(float(w))) for i, w in enumerate(s.weights)]
    # A row per source; text sorts by its bytes, which for UTF-8 is the order of code points.
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    placed = totals.withColumn("_place", F.row_number().over(ordered) - 1).withColumn("_weight", F.coalesce(*places))
    most = F.lit(float(s.most_copies)) * F.col("source_size")
    filling = Window.orderBy(F.col("_full"), F.col("_place"))
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (
        placed.withColumn("_most", most).withColumn("_full", F.col("_most") / F.col("_weight"))
        .withColumn("_all", F.sum("source_size").over(everything)).withColumn("_weights", F.sum("_weight").over(everything))
        .withColumn("_taken", F.coalesce(F.sum("_most").over(before), F.lit(0.0)))
        .withColumn("_gone", F.coalesce(F.sum("_weight").over(before), F.lit(0.0)))
        .withColumn("_level", (F.col("_all") - F.col("_taken")) / (F.col("_weights") - F.col("_gone")))
    )
    first_open = F.min(F.when(F.col("_full") > F.col("_level"), F.struct("_full", "_place", "_level"))).over(everything)
    open_ = first_open["_level"]
    target = F.least(F.col("_most"), F.col("_weight") * F.coalesce(open_, F.lit(float("inf"))))
    return level.select("source", "source_size", target.alias("target"))


def _multipliers(sizes: DataFrame, targets: DataFrame, s: MixSettings) -> DataFrame:
    """``source, lam, unit``: the rate of a document is ``least(most_copies, exp(lam * size / unit))``.

    A source that needs all its copies has a missing ``lam``.
    """
    most = F.lit(float(s.most_copies))
    pairs = materialize(sizes.filter("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")), "mix-sizes")
    unit = pairs.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("unit"))
    joined = targets.join(unit.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    full = F.col("target") >= most * F.col("source_size") * (1 - 1e-12)
    start = F.when(full, F.lit(None)).otherwise(F.lit(0.0)).cast("double")
    state = joined.select("source", "target", "unit", start.alias("lam"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(False).alias("done"))
    state = materialize(state.withColumn("done", F.col("lam").isNull()), "mix-dual")
    for _ in range(s.most_rounds):
        if state.filter("not done").isEmpty():
            break
        at = state.filter("not done").select(F.col("source").alias("_s"), "unit", "lam")
        z = F.col("size") / F.col("unit")
        raw = F.exp(F.least(F.col("lam") * z, F.lit(700.0)))
        words = F.col("size") * F.col("n")
        sums = pairs.join(at, F.col("source").eqNullSafe(F.col("_s"))).groupBy(F.col("_s")).agg(
            F.sum(words * F.least(raw, most)).alias("_value"), F.sum(F.when(raw < most, words * z * raw).otherwise(0.0)).alias("_slope")
        )
        near = F.abs(F.col("_value") - F.col("target")) <= s.tolerance * F.col("target")
        low = F.when(F.col("_value") < F.col("target"), F.col("lam")).otherwise(F.col("low"))
        high = F.when(F.col("_value") >= F.col("target"), F.col("lam")).otherwise(F.col("high"))
        newton = F.col("lam") - (F.col("_value") - F.col("target")) / F.col("_slope")
        # Outside the bracket: halve it, or step further where one end is open.
        inside = F.col("_slope").isNotNull() & (F.col("_slope") > 0) & (F.coalesce(newton > F.col("_low"), F.lit(True))) & (
            F.coalesce(newton < F.col("_high"), F.lit(True))
        ) & (F.abs(newton - F.col("lam")) <= 4)
        halved = F.when(F.col("_low").isNull(), F.col("_high") - 4).when(F.col("_high").isNull(), F.col("_low") + 4).otherwise((F.col("_low") + F.col("_high")) / 2)
        moved = state.join(sums, F.col("source").eqNullSafe(F.col("_s")), "left").withColumn("_low", low).withColumn("_high", high)
        moved = moved.select(
            "source", "target", "unit",
            F.when(F.col("done") | near, F.col("lam")).otherwise(F.when(inside, newton).otherwise(halved)).alias("lam"),
            F.coalesce("_low", "low").alias("low"), F.coalesce("_high", "high").alias("high"), (F.col("done") | F.coalesce(near, F.lit(False))).alias("done"),
        )
        state = materialize(moved, "mix-dual")
    return state.select("source", "lam", "unit")


def mix_copies(sizes: DataFrame, s: MixSettings) -> DataFrame:
    """``doc, source, size`` (one row per document) to the same rows with ``source_size, target, rate, copies``."""
    targets = materialize(source_targets(sizes, s), "mix-targets")
    dual = _multipliers(sizes, targets, s)
    counts = sizes.groupBy("source").agg(F.count("*").alias("_n"))
    facts = targets.join(dual.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    facts = facts.join(counts.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    facts = materialize(facts.withColumnRenamed("source", "_s"), "mix-facts")
    most = float(s.most_copies)
    rated = sizes.join(facts, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rate = F.when(F.col("size") == 0, 0.0).when(F.col("lam").isNull(), most).otherwise(
        F.least(F.lit(most), F.exp(F.least(F.col("lam") * F.col("size") / F.col("unit"), F.lit(700.0))))
    )
    rated = rated.withColumn("rate", rate).withColumn("_bucket", F.pmod(F.xxhash64("doc", "size"), F.ceil(F.col("_n") / s.bucket)))
    # A bucket of identical rows (one repeated document) could be large: equal rows are counted, not listed.
    same = rated.groupBy("source", "_bucket", "size", "doc").agg(
        F.count("*").alias("_same"), F.first("rate").alias("rate"), F.first("source_size").alias("source_size"), F.first("target").alias("target")
    )
    lists = same.groupBy("source", "_bucket", "source_size", "target").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("minus"), "doc", "_same", "rate")), True).alias("docs")
    )
    # For _same equal rows with rate r the copies in all are one of the two whole numbers next to r * _same.
    first = F.struct(F.lit(0.0).alias("owed"), F.array().cast("array<struct<doc:bigint,size:bigint,same:bigint,rate:double,all:bigint>>").alias("out"))

    def step(state: Column, d: Column) -> Column:
        size, wanted = (-d["minus"]).cast("double"), d["rate"] * d["_same"]
        low = F.floor(wanted)
        owed = state["owed"] + (wanted - low) * size
        up = ((owed * 2 > size) & (low < d["_same"] * s.most_copies)).cast("long")
        taken = (low + up).cast("long")
        row = F.struct(d["doc"].alias("doc"), (-d["minus"]).cast("long").alias("size"), d["_same"].alias("same"), d["rate"].alias("rate"), taken.alias("all"))
        return F.struct((owed - up * size).alias("owed"), F.concat(state["out"], F.array(row)).alias("out"))

    folded = lists.withColumn("_row", F.explode(F.aggregate("docs", first, step)["out"]))
    parts = folded.select("source", "source_size", "target", "_row.*")
    # Equal rows share their copies as evenly as whole numbers allow.
    each = parts.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("same") - 1)))
    whole = F.floor(F.col("all") / F.col("same"))
    copies = whole + (F.col("_i") < F.col("all") - whole * F.col("same")).cast("long")
    return each.select("doc", "source", "size", "source_size", "target", "rate", copies.cast("long").alias("copies"))


def document_sizes(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    sizes = docs.select(known_id(doc_id).alias("doc"), F.col(f"`{source}`").alias("source"), word_count(text).alias("size"))
    return materialize(sizes, "mix-docs")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", settings: MixSettings = MixSettings()) -> DataFrame:
    """``doc_id, source, size, source_size, target, rate, copies, taken`` for every row of ``docs``; no text is moved."""
    made = mix_copies(document_sizes(docs, doc_id, text, source), settings)
    return made.select(
        F.nullif("doc", F.lit((1 << 63) - 1)).alias("doc_id"), "source", "size", "source_size", "target", "rate", "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", settings: MixSettings = MixSettings()) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken.

    Rows with the same id, source and size are interchangeable: their copies are dealt among them.
    """
    key, size, turn, own, copy, of, held, words, same, total = unused(
        docs, "_doc", "_size", "_turn", "_own", "_copy", "_of", "_held", "_words", "_same", "_all"
    )
    made = mix_copies(document_sizes(docs, doc_id, text, source), settings)
    counted = made.groupBy("doc", "source", "size").agg(F.count("*").alias("n"), F.sum("copies").alias("all"))
    counted = counted.toDF(of, held, words, same, total)
    rows = docs.withColumn(key, known_id(doc_id)).withColumn(size, word_count(text))
    joined = rows.join(counted, (F.col(key) == F.col(of)) & F.col(f"`{source}`").eqNullSafe(F.col(held)) & (F.col(size) == F.col(words)))
    alone = joined.filter(F.col(same) == 1).withColumn(own, F.col(total))
    dealt = joined.filter(F.col(same) > 1).withColumn(turn, F.row_number().over(Window.partitionBy(of, held, words).orderBy(key)))
    whole = F.floor(F.col(total) / F.col(same))
    several = dealt.withColumn(own, whole + (F.col(turn) <= F.col(total) - whole * F.col(same)).cast("long")).drop(turn)
    taken = alone.unionByName(several).filter(F.col(own) > 0)
    copied = taken.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(own).cast("long"))))
    return copied.select(*[F.col(f"`{c}`") for c in docs.columns])
