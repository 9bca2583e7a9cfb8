"""Batch jobs over request and conversation tables."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sievework.functions.columns import quoted

# The tools in their order of precedence, each with its intent and keywords.
TOOL_KEYWORDS: Mapping[str, tuple[str, Sequence[str]]] = {
    "dataset_preview": (
        "preview_dataset",
        (
            "preview", "sample", "show data", "show dataset", "show table", "display data", "display dataset",
            "view data", "view dataset", "head", "show head", "first rows", "first row", "top rows", "top row",
            "show first", "show first rows", "show first 5 rows", "show first 10 rows", "show top",
            "show top rows", "show top 5 rows", "show top 10 rows", "sample rows", "sample data",
            "sample records", "show sample", "show sample data", "show sample rows", "display rows",
            "display records", "display first rows", "list rows", "list records", "peek", "peek data",
            "peek dataset", "inspect data", "inspect dataset", "head()", "df.head",
        ),
    ),
    "dataset_summary": (
        "summarize_dataset",
        (
            "summarize", "summary", "describe", "overview", "profile", "dataset summary", "analyze", "analyse",
            "analysis", "insights", "explore", "tell me about", "what can you tell me", "understand the data",
        ),
    ),
    "column_information": (
        "column_information",
        ("column", "columns", "schema", "datatype", "data type", "field"),
    ),
    "value_counts": (
        "value_counts",
        (
            "value counts", "frequency", "frequencies", "most common", "distinct values", "how many of each",
            "distribution of", "count by value", "unique values",
        ),
    ),
    "group_by": ("group_by", ("group by", "grouped by", "breakdown by", "by category")),
    "correlation": (
        "correlation",
        (
            "correlation", "correlate", "relationship", "correlation matrix", "related", "correlated",
            "connection between", "affect", "impact",
        ),
    ),
    "filtering": ("filter_dataset", ("filter", "where", "rows with", "only rows", "contains")),
    "sorting": (
        "sort_dataset",
        ("sort", "order by", "ascending", "descending", "highest", "lowest"),
    ),
    "aggregations": (
        "aggregate_dataset",
        (
            "sum", "avg", "average", "mean", "min", "max", "count", "median", "total", "how much", "how many",
            "grand total", "overall",
        ),
    ),
    "sql_list_tables": (
        "sql_list_tables",
        ("list tables", "show tables", "database tables", "available tables"),
    ),
    "sql_column_metadata": (
        "sql_column_metadata",
        ("column metadata", "table schema", "table columns", "column types"),
    ),
    "sql_preview_table": (
        "sql_preview_table",
        ("preview table", "show table", "table preview", "first rows from table"),
    ),
    "sql_execute_query": (
        "sql_execute_query",
        ("select", "with", "sql query", "run query", "execute query"),
    ),
    "visualization_dashboard": (
        "visualize_dashboard",
        (
            "dashboard", "visualize", "chart", "plot", "graph", "histogram", "scatter", "line chart",
            "bar chart", "pie chart", "box plot", "heatmap", "kpi", "kpis", "kpi card", "kpi cards", "card",
            "cards", "table", "visualise", "show me a chart", "draw", "diagram", "report",
        ),
    ),
}
FALLBACK_TOOL, FALLBACK_INTENT, FALLBACK_CONFIDENCE = "no_available_tool", "general_chat", 0.4

# Sizes of a prompt history.
RECENT_MESSAGES = 12
HISTORY_CHARACTERS = 6000
PREVIEW_CHARACTERS = 120


_LETTER = r"[\p{L}\p{N}_]"


_HITS = "map<string, array<struct<tool: int, keyword: int>>>"


def _is_letter(character: str) -> bool:
    """As ``_LETTER``, for the keywords themselves."""
    return character.isalnum() or character == "_"


def keyword_pattern(keywords: Iterable[str]) -> str:
    """One pattern for all keywords: a tree by characters that finds the longest one at each place.

    The match is inside a look-ahead, so keywords may overlap: the search goes on at
    the next character.  Any number of blanks stands for one.
    """
    tree: dict = {}
    for keyword in keywords:
        node = tree
        for character in keyword:
            node = node.setdefault(character, {})
        node[""] = {}

    def written(character: str) -> str:
        return r"\s+" if character == " " else re.sub(r"([^\w\s])", r"\\\1", character)

    def branch(node: dict) -> str:
        ways = [written(c) + branch(below) for c, below in sorted(node.items()) if c]
        if "" in node:  # after the longer ones
            ways.append(f"(?!{_LETTER})")
        return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"

    return f"(?<!{_LETTER})(?=({branch(tree)}))"


def _implied(keywords: Sequence[Sequence[str]]) -> dict[str, list[dict[str, int]]]:
    """For each keyword of any tool, all keywords (by tool and number) that are found where it is the longest found."""
    own = [(word, {"tool": i, "keyword": k}) for i, words in enumerate(keywords) for k, word in enumerate(words)]
    return {
        longest: [
            place
            for word, place in own
            if longest.startswith(word) and not _is_letter(longest[len(word) : len(word) + 1] or " ")
        ]
        for longest in {word for word, _ in own}
    }


def route_requests(
    df: DataFrame, text: str, tools: Mapping[str, tuple[str, Sequence[str]]] = TOOL_KEYWORDS
) -> DataFrame:
    """Add tool_name, intent, confidence and keyword_count to each request.

    The tool with most matching keywords wins, the earlier one on ties.  The
    keyword table is a constant, so each request is routed where it lies: no
    join, no shuffle.  All keywords of all tools are one pattern and one
    constant table, so a text is read once and the plan does not grow with them.
    """
    words = [[" ".join(k.lower().split()) for k in keywords] for _, keywords in tools.values()]
    words = [[word for word in own if word] for own in words]
    found = F.array().cast("array<struct<tool: int, keyword: int>>")
    if any(words):
        lowered = F.lower(F.coalesce(quoted(text), F.lit("")))
        longest = F.regexp_extract_all(lowered, F.lit(keyword_pattern(w for own in words for w in own)), 1)
        plain = F.array_distinct(F.transform(longest, lambda x: F.regexp_replace(x, r"\s+", " ")))
        table = F.from_json(F.lit(json.dumps(_implied(words), sort_keys=True)), _HITS)
        found = F.array_distinct(F.flatten(F.transform(plain, lambda x: table[x])))
    offered = json.dumps([{"order": -i, "tool": tool, "intent": intent} for i, (tool, (intent, _)) in enumerate(tools.items())])
    choices = F.from_json(F.lit(offered), "array<struct<order: int, tool: string, intent: string>>")

    def best_of(hits: Column) -> Column:
        def score(t: Column) -> Column:
            n = F.size(F.filter(hits, lambda hit: hit["tool"] == -t["order"]))
            return F.struct(n.alias("n"), t["order"].alias("order"), t["tool"].alias("tool"), t["intent"].alias("intent"))

        return F.array_max(F.transform(choices, score))

    # Bound to a lambda's variable, the hits of a text are found once, not once a tool.
    best = df.withColumn("__best", F.transform(F.array(found), best_of)[0])
    n = F.col("__best.n")
    return best.select(
        *[quoted(c) for c in df.columns],
        F.when(n > 0, F.col("__best.tool")).otherwise(FALLBACK_TOOL).alias("tool_name"),
        F.when(n > 0, F.col("__best.intent")).otherwise(FALLBACK_INTENT).alias("intent"),
        F.when(n > 0, F.least(F.lit(0.95), F.lit(0.45) + F.lit(0.1) * n))
        .otherwise(FALLBACK_CONFIDENCE)
        .alias("confidence"),
        n.alias("keyword_count"),
    )


def _number_after(text: Column, words: str, default: int, most: int | None) -> Column:
    """The first whole number after one of ``words``, held to 1..most."""
    digits = F.regexp_extract(text, rf"(?iU)\b(?:{words})\s+(\d+)\b", 1)
    ceiling = most if most is not None else (1 << 63) - 1
    # Only numbers beyond the range of a long are held to its largest value.
    value = F.coalesce(digits.try_cast("bigint"), F.lit(ceiling))
    value = F.greatest(F.lit(1), F.least(F.lit(ceiling), value))
    return F.when(digits == "", F.lit(default)).otherwise(value).cast("long")


def extract_limits(
    df: DataFrame, text: str, default_limit: int = 20, most: int = 50, default_size: int = 25
) -> DataFrame:
    """Add row_limit, page and page_size as asked for in the request text."""
    request = F.coalesce(quoted(text), F.lit(""))
    return df.select(
        "*",
        _number_after(request, "top|first|last|limit", default_limit, most).alias("row_limit"),
        _number_after(request, "page", 1, None).alias("page"),
        _number_after(request, "page size|limit|top|first", default_size, 100).alias("page_size"),
    )


def recent_messages(
    df: DataFrame, session: str = "conv_id", order: str = "turn", limit: int = RECENT_MESSAGES
) -> DataFrame:
    """The last ``limit`` messages of each session.

    Spark cuts each task's share to ``limit`` rows per session before the
    shuffle, so a very long session does not pile up anywhere.
    """
    newest = Window.partitionBy(quoted(session)).orderBy(quoted(order).desc())
    return df.withColumn("__n", F.row_number().over(newest)).filter(F.col("__n") <= limit).drop("__n")


def conversation_summary(
    df: DataFrame, session: str = "conv_id", order: str = "turn", text: str = "text"
) -> DataFrame:
    """session, message_count, last_message_preview (its first 120 characters)."""
    return df.groupBy(quoted(session)).agg(
        F.count(F.lit(1)).alias("message_count"),
        F.substring(F.max_by(quoted(text), quoted(order)), 1, PREVIEW_CHARACTERS).alias("last_message_preview"),
    )


def format_history(
    df: DataFrame,
    session: str = "conv_id",
    order: str = "turn",
    role: str = "role",
    text: str = "text",
    limit: int = RECENT_MESSAGES,
    most: int = HISTORY_CHARACTERS,
) -> DataFrame:
    """session, history: ``role: text`` lines of the recent messages, cut with a note when too long."""
    recent = recent_messages(df, session, order, limit)
    lines = F.transform(
        # At most ``limit`` messages per session are collected.
        F.array_sort(F.collect_list(F.struct(quoted(order).alias("o"), quoted(role).alias("r"), quoted(text).alias("t")))),
        lambda m: F.concat(m["r"], F.lit(": "), F.coalesce(m["t"], F.lit(""))),
    )
    joined = recent.groupBy(quoted(session)).agg(F.array_join(lines, "\n").alias("history"))
    full = F.col("history")
    # Fixed value: the wording of the note.
    note = F.format_string(
        "\n\n[Truncated %d characters to keep the model request within limits.]", F.length(full) - most
    )
    cut = F.when(F.length(full) <= most, full).otherwise(F.concat(F.substring(full, 1, most), note))
    return joined.select(quoted(session), cut.alias("history"))


def conversation_artifacts(
    df: DataFrame,
    session: str = "conv_id",
    order: str = "turn",
    artifacts: str = "artifacts",
    sql: str = "generated_sql",
) -> DataFrame:
    """session, kind, message_no, item_no, title, body: everything a session produced, in order.

    ``artifacts`` is an array of (kind, title, body).  SQL texts are trimmed and
    kept once per session, where they first occur.
    """
    items = df.select(
        quoted(session), quoted(order).alias("message_no"), F.posexplode(quoted(artifacts)).alias("item_no", "item")
    ).select(quoted(session), "item.kind", "message_no", "item_no", "item.title", "item.body")
    snippet = F.regexp_replace(quoted(sql), r"(?U)^\s+|\s+$", "")
    snippets = (
        df.select(quoted(session), quoted(order).alias("message_no"), snippet.alias("body"))
        .filter(F.col("body") != "")
        .groupBy(quoted(session), "body")
        .agg(F.min("message_no").alias("message_no"))
        .select(
            quoted(session),
            F.lit("sql").alias("kind"),
            "message_no",
            F.lit(0).alias("item_no"),
            F.lit(None).cast("string").alias("title"),
            "body",
        )
    )
    return items.unionByName(snippets)
