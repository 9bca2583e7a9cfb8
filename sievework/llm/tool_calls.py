"""Chat formatting: link tool calls with their results, order, validate and serialise them.

``calls``: ``conv_id, turn, call_id, name, arguments`` (JSON text), ``depends_on`` (ids of
calls of the same conversation).  ``results``: ``conv_id, turn, call_id, content``.

* Calls and results are hash-joined by conversation and id.  Of several calls or
  results with one id the earliest counts (ties: the smallest content); the others
  stay as rows of kind ``repeated_call`` or ``repeated_result``.
* Order: a call comes after all calls it depends on.  Its place is (latest turn among
  itself and what it needs, level within that turn); calls on a cycle, or after one,
  have no level.  Calls already in order of their turns need one look at each
  dependency; others take a round for each step of their longest chain.
* Arguments are checked against the tool's schema: names, required ones, JSON types.
* Canonical JSON: keys sorted, no blanks, numbers normalised, missing parts left out.

Defined cases: missing arguments are an empty object; arguments that are no JSON object
are an error and are kept as text; a result without a call is kind ``orphan_result``;
dependencies on ids that do not exist are ignored; a missing id or conversation links to nothing.
Only DataFrame and SQL functions are used.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from sievework.session import materialize

KEY = ["conv_id", "call_id"]
_NAMED = "conv_id is not null and call_id is not null"
#: JSON type to the SQL types that a parsed value may have.
_TYPES = {
    "integer": "^BIGINT", "number": "^(BIGINT|DOUBLE|DECIMAL)", "string": "^STRING", "boolean": "^BOOLEAN", "array": "^ARRAY",
    "object": "^OBJECT", "null": "^VOID",
}
#: tool -> argument -> (JSON type, required)
Schemas = Mapping[str, Mapping[str, tuple[str, bool]]]


def _earliest(rows: DataFrame, *ties: str) -> DataFrame:
    """Rows with ``_first``: whether a row is the earliest of its id; equal rows are numbered by their count."""
    rest = [c for c in rows.columns if c not in KEY]
    same = rows.groupBy(*rows.columns).agg(F.count("*").alias("_same"))
    order = F.struct("turn", *ties)
    least = same.filter(_NAMED).groupBy(*KEY).agg(F.min(order).alias("_least"))
    marked = same.join(least, KEY, "left").withColumn("_hit", F.coalesce(order.eqNullSafe(F.col("_least")), F.lit(False)) | ~F.expr(_NAMED))
    # Of equal rows one is the first; a row without an id is never a repeat.
    turns = marked.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_same"))))
    return turns.select(*KEY, *rest, (F.col("_hit") & ((F.col("_i") == 1) | ~F.expr(_NAMED))).alias("_first"))


def argument_errors(schemas: Schemas) -> Column:
    """Sorted errors of ``arguments`` (an object as ``_args``, null if it is none) for the tool ``name``."""
    tools = F.array(*[F.lit(t) for t in schemas]) if schemas else F.array().cast("array<string>")
    known = F.array_contains(tools, F.col("name"))
    kinds = {f"{t}\0{a}": _TYPES[kind] for t, args in schemas.items() for a, (kind, _) in args.items()}
    kind_of = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]) if kinds else F.create_map().cast("map<string,string>")
    needed = F.lit(None).cast("array<string>")
    for tool, args in schemas.items():
        names = F.array(*[F.lit(a) for a, (_, required) in args.items() if required]).cast("array<string>")
        needed = F.when(F.col("name") == tool, names).otherwise(needed)
    entries = F.map_entries(F.col("_args"))

    def fault(e: Column) -> Column:
        kind = kind_of[F.concat(F.col("name"), F.lit("\0"), e["key"])]
        wrong = ~F.rlike(F.coalesce(F.schema_of_variant(e["value"]), F.lit("VOID")), kind)
        return F.when(kind.isNull(), F.concat(F.lit("unknown argument "), e["key"])).when(wrong, F.concat(F.lit("wrong type of "), e["key"]))

    faults = F.filter(F.transform(entries, fault), lambda x: x.isNotNull())
    lacking = F.transform(F.array_except(needed, F.map_keys("_args")), lambda a: F.concat(F.lit("missing argument "), a))
    return (
        F.when(F.col("_args").isNull(), F.array(F.lit("arguments are no object")))
        .when(~F.coalesce(known, F.lit(False)), F.array(F.lit("unknown tool")))
        .otherwise(F.array_sort(F.concat(faults, lacking)))
    )


def call_order(calls: DataFrame) -> DataFrame:
    """``conv_id, call_id, order_turn, order_level`` of calls with distinct ids (``depends_on`` may be missing)."""
    nodes = calls.select(*KEY, "turn")
    edges = calls.select(*KEY, F.explode(F.array_distinct("depends_on")).alias("dep"))
    known = nodes.select("conv_id", F.col("call_id").alias("dep"), F.col("turn").alias("dep_turn"))
    edges = materialize(edges.join(known, ["conv_id", "dep"]).join(nodes, KEY), "call-edges")
    place = nodes.withColumnRenamed("turn", "order_turn")
    if not edges.filter("dep_turn > turn").isEmpty():
        while True:
            late = place.select("conv_id", F.col("call_id").alias("dep"), F.col("order_turn").alias("dep_turn"))
            push = edges.select(*KEY, "dep").join(late, ["conv_id", "dep"]).groupBy(*KEY).agg(F.max("dep_turn").alias("_t"))
            moved = place.join(push, KEY, "left").select(*KEY, F.greatest("order_turn", "_t").alias("order_turn"), (F.col("_t") > F.col("order_turn")).alias("_moved"))
            moved = materialize(moved, "call-turns")
            place = moved.drop("_moved")
            if moved.filter("_moved").isEmpty():
                break
    mine = place.select("conv_id", "call_id", F.col("order_turn").alias("t"))
    theirs = place.select("conv_id", F.col("call_id").alias("dep"), F.col("order_turn").alias("u"))
    open_ = edges.select(*KEY, "dep").join(mine, KEY).join(theirs, ["conv_id", "dep"]).filter("t = u").select(*KEY, "dep")
    open_ = materialize(open_, "call-open")
    waiting = open_.select(*KEY).unionByName(open_.select("conv_id", F.col("dep").alias("call_id"))).distinct()
    levels, level = [], 0
    while not open_.isEmpty():
        waiting = materialize(waiting, "call-waiting")
        ready = materialize(waiting.join(open_, KEY, "left_anti"), "call-ready")
        if ready.isEmpty():
            break
        levels.append(ready.withColumn("_level", F.lit(level)))
        waiting = waiting.join(ready, KEY, "left_anti")
        open_ = materialize(open_.join(ready.withColumnRenamed("call_id", "dep"), ["conv_id", "dep"], "left_anti").select(*KEY, "dep"), "call-open")
        level += 1
    # What is left after the last round is ready if nothing is open, else on or behind a cycle.
    if open_.isEmpty():
        levels.append(waiting.withColumn("_level", F.lit(level)))
    else:
        levels.append(waiting.withColumn("_level", F.lit(None).cast("int")))
    placed = levels[0]
    for more in levels[1:]:
        placed = placed.unionByName(more)
    placed = placed.withColumn("_placed", F.lit(True))
    found = place.join(placed, KEY, "left")
    return found.select(*KEY, "order_turn", F.when(F.col("_placed"), F.col("_level")).otherwise(F.lit(0)).alias("order_level"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row per call and per result without one.

    ``conv_id, call_id, kind, turn, result_turn, order_turn, order_level, errors, json``.
    """
    calls = calls.select("conv_id", "turn", "call_id", "name", "arguments", "depends_on")
    numbered = materialize(_earliest(calls, "name", "arguments", "depends_on"), "calls")
    first = numbered.filter(f"_first and {_NAMED}").drop("_first")
    other = numbered.filter(f"not (_first and {_NAMED})").drop("_first")
    answers = materialize(_earliest(results.select("conv_id", "turn", "call_id", "content"), "content"), "results")
    answer = answers.filter(f"_first and {_NAMED}").select(*KEY, F.col("turn").alias("result_turn"), "content")
    linked = first.join(answer.hint("shuffle_hash"), KEY, "left").join(call_order(first), KEY, "left").withColumn("kind", F.lit("call"))
    again = other.select("*", F.lit(None).cast("long").alias("result_turn"), F.lit(None).cast("string").alias("content"), F.col("turn").alias("order_turn"), F.lit(0).alias("order_level"))
    again = again.withColumn("kind", F.when(~F.expr(_NAMED), "call").otherwise("repeated_call"))
    rows = linked.unionByName(again)
    given = F.coalesce("arguments", F.lit("{}"))
    parsed = F.try_parse_json(given)
    object_ = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    rows = rows.withColumn("_args", F.when(object_, F.try_variant_get(parsed, "$", "map<string,variant>")))
    shown = F.when(object_, F.to_json(parsed)).otherwise(_text(given))
    body = F.concat(
        F.lit('{"arguments":'), shown, _field("id", "call_id"), _field("name", "name"), _field("result", "content"), F.lit("}")
    )
    made = rows.select(*KEY, "kind", "turn", "result_turn", "order_turn", "order_level", argument_errors(schemas).alias("errors"), body.alias("json"))
    # Results that no call took.
    spare = answers.join(first.select(*KEY, F.lit(True).alias("_called")), KEY, "left").filter("not _first or _called is null")
    kind = F.when(F.col("_called") & ~F.col("_first"), "repeated_result").otherwise("orphan_result")
    loose = F.concat(F.lit('{"content":'), F.coalesce(_text(F.col("content")), F.lit("null")), _field("id", "call_id"), F.lit("}"))
    spare = spare.select(
        *KEY, kind.alias("kind"), "turn", F.col("turn").alias("result_turn"), F.col("turn").alias("order_turn"), F.lit(0).alias("order_level"),
        F.array().cast("array<string>").alias("errors"), loose.alias("json"),
    )
    return made.unionByName(spare)


def _text(value: Column) -> Column:
    """A JSON string literal."""
    whole = F.to_json(F.struct(value.cast("string").alias("v")))  # {"v":...}
    return F.when(value.isNotNull(), whole.substr(F.lit(6), F.length(whole) - 6))


def _field(name: str, column: str) -> Column:
    return F.coalesce(F.concat(F.lit(f',"{name}":'), _text(F.col(column))), F.lit(""))


def message_json(role: str, text: str) -> Column:
    """A plain message as canonical JSON."""
    return F.concat(F.lit('{"content":'), F.coalesce(_text(F.col(text)), F.lit("null")), _field("role", role), F.lit("}"))
