"""Requests and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.plans.requests import (
    FALLBACK_CONFIDENCE,
    FALLBACK_INTENT,
    FALLBACK_TOOL,
    TOOL_KEYWORDS,
    conversation_artifacts,
    conversation_summary,
    extract_limits,
    format_history,
    recent_messages,
    route_requests,
)
from suite.common import Suite, rounded, table

suite = Suite()

_NOT_WORD = r"[^\pL\pN_]"


def _keyword(keyword: str) -> str:
    words = [w.replace("(", r"\(").replace(")", r"\)").replace(".", r"\.") for w in keyword.split()]
    pattern = rf"(^|{_NOT_WORD})" + r"\s+".join(words) + rf"($|{_NOT_WORD})"
    return f"regexp_matches(t, '{pattern}')::int"


def _route_sql(keys: str, origin: str) -> str:
    scores = ", ".join(
        f"{{'n': {' + '.join(_keyword(k) for k in keywords)}, 'o': {-i}, 'tool': '{tool}', 'intent': '{intent}'}}"
        for i, (tool, (intent, keywords)) in enumerate(TOOL_KEYWORDS.items())
    )
    return (
        f"select {keys}, case when b.n > 0 then b.tool else '{FALLBACK_TOOL}' end as tool_name, case when b.n > 0 then "
        f"b.intent else '{FALLBACK_INTENT}' end as intent, round(case when b.n > 0 then least(0.95, 0.45 + 0.1 * b.n)::double "
        f"else {FALLBACK_CONFIDENCE} end, 4) as confidence, b.n::int as keyword_count from (select {keys}, "
        f"list_max([{scores}]) as b from (select {keys}, lower(text) as t from {origin}))"
    )


suite.add(
    "r1_route_requests",
    lambda s, d: rounded(
        route_requests(table(s, d, "conversations").select("conv_id", "turn", "text"), "text").drop("text")
    ),
    _route_sql("conv_id, turn", "conversations"),
)
suite.add(
    "r1_route_documents",
    lambda s, d: rounded(route_requests(table(s, d, "documents").select("doc_id", "text"), "text").drop("text")),
    _route_sql("doc_id", "documents"),
)


def _requests(s, d):
    documents = table(s, d, "documents")
    wording = F.element_at(
        F.array(*[F.lit(w) for w in (" Top ", " limit  ", " page ", " page size ", " first rows ")]),
        (F.col("doc_id") % 5 + 1).cast("int"),
    )
    return documents.select(
        "doc_id",
        F.concat("text", wording, F.col("n_chars").cast("string"), F.lit(", page "), F.col("doc_id").cast("string")).alias(
            "request"
        ),
    )


_REQUESTS = (
    "(select doc_id, text || [' Top ', ' limit  ', ' page ', ' page size ', ' first rows '][doc_id % 5 + 1] || n_chars || "
    "', page ' || doc_id as request from documents)"
)


def _after(words: str, default: int, most: int) -> str:
    found = rf"regexp_extract(request, '\b(?:{words})\s+(\d+)\b', 1, 'i')"
    return (
        f"case when {found} = '' then {default} else greatest(1, least({most}, coalesce(try_cast({found} as bigint), "
        f"{most}))) end::bigint"
    )


suite.add(
    "r2_extract_limits",
    lambda s, d: extract_limits(_requests(s, d), "request").drop("request"),
    f"select doc_id, {_after('top|first|last|limit', 20, 50)} as row_limit, {_after('page', 1, 10**18)} as page, "
    f"{_after('page size|limit|top|first', 25, 100)} as page_size from {_REQUESTS}",
)
suite.add(
    "r3_recent_messages",
    lambda s, d: recent_messages(table(s, d, "conversations"), limit=3),
    "select * from conversations qualify row_number() over (partition by conv_id order by turn desc) <= 3",
)
suite.add(
    "r4_conversation_summary",
    lambda s, d: conversation_summary(table(s, d, "conversations")),
    "select conv_id, count(*) as message_count, substring(arg_max(text, turn), 1, 120) as last_message_preview from "
    "conversations group by 1",
)
suite.add(
    "r5_format_history",
    lambda s, d: format_history(table(s, d, "conversations")),
    "with h as (select conv_id, string_agg(role || ': ' || text, chr(10) order by turn) as h from (select * from "
    "conversations qualify row_number() over (partition by conv_id order by turn desc) <= 12) group by 1) select conv_id, "
    "case when length(h) <= 6000 then h else substring(h, 1, 6000) || chr(10) || chr(10) || '[Truncated ' || (length(h) - "
    "6000) || ' characters to keep the model request within limits.]' end as history from h",
)


def _with_artifacts(s, d):
    """Answers carry a figure and a table; every message names the query behind it."""
    talk = table(s, d, "conversations")
    item = lambda kind, title, body: F.struct(
        F.lit(kind).alias("kind"), title.alias("title"), body.alias("body")
    )
    length = F.length("text").cast("string")
    items = F.array(item("kpi", F.lit("Characters"), length), item("table", F.col("role"), F.col("text")))
    empty = F.filter(items, lambda i: F.lit(False))
    return talk.select(
        "conv_id",
        "turn",
        F.when(F.col("role") == "assistant", items).otherwise(empty).alias("artifacts"),
        F.when(F.col("turn") > 0, F.concat(F.lit("  select "), (F.col("turn") % 2).cast("string"), F.lit("\n")))
        .otherwise(F.lit(" "))
        .alias("generated_sql"),
    )


suite.add(
    "r6_conversation_artifacts",
    lambda s, d: conversation_artifacts(_with_artifacts(s, d)),
    "select conv_id, 'kpi' as kind, turn as message_no, 0 as item_no, 'Characters' as title, length(text)::varchar as body "
    "from conversations where role = 'assistant' union all select conv_id, 'table', turn, 1, role, text "
    "from conversations where role = 'assistant' union all select conv_id, 'sql', min(turn), 0, null, 'select ' || (turn % "
    "2) from conversations where turn > 0 group by conv_id, turn % 2",
)
