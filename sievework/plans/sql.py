"""Read-only SQL over Spark tables and views."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from sievework.errors import ReadOnlyError
from sievework.functions.ordering import Order
from sievework.operators.sorting import Page, paginate, preview
from sievework.plans.profile import Profile, build_profile

# Words that may not occur anywhere in a statement, and how one may start.
BLOCKED_WORDS = ("DROP", "DELETE", "UPDATE", "ALTER", "TRUNCATE", "INSERT", "MERGE", "EXEC")
STARTING_WORDS = ("SELECT", "WITH")
#: Functions that run code outside of SQL.
BLOCKED_FUNCTIONS = ("reflect", "java_method", "try_reflect")
_LITERAL = r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`(?:[^`]|``)*`"""
MAX_PAGE = 1000


def _without_comments(sql: str) -> str:
    """For checking only: comment marks inside literals are part of the literal."""
    parts = re.compile(rf"({_LITERAL})|/\*.*?\*/|--[^\n]*", re.DOTALL)
    return parts.sub(lambda m: m[1] or " ", sql).strip()


def validate(sql: str) -> str:
    """The statement as it was given, less a closing semicolon, if it only reads.

    What is checked is the statement without its comments; what runs is unaltered.
    """
    text = _without_comments(sql)
    body = text.rstrip().rstrip(";").strip()
    if not body:
        raise ReadOnlyError("There is no statement.")
    if ";" in body:
        raise ReadOnlyError("Only one statement at a time.")
    blocked = re.search(rf"\b({'|'.join(BLOCKED_WORDS)})\b", body, re.IGNORECASE)
    if blocked:
        raise ReadOnlyError(f"'{blocked.group(1).upper()}' is not allowed in a read-only statement.")
    called = re.search(rf"\b({'|'.join(BLOCKED_FUNCTIONS)})`?\s*\(", body, re.IGNORECASE)
    if called:
        raise ReadOnlyError(f"'{called.group(1).lower()}' is not allowed in a read-only statement.")
    if not re.match(rf"({'|'.join(STARTING_WORDS)})\b", body, re.IGNORECASE):
        raise ReadOnlyError("A statement must start with SELECT or WITH.")
    return _closing.sub("", sql).strip()


#: A semicolon with nothing but blanks and comments after it.
_closing = re.compile(r";(?=(?:\s|/\*.*?\*/|--[^\n]*(?:\n|\Z))*\Z)", re.DOTALL)


def read_only_query(spark: SparkSession, sql: str, views: dict[str, DataFrame] | None = None) -> DataFrame:
    """The result of one SELECT, as a lazy DataFrame; ``views`` names tables for it.

    The names hold while the statement is analysed; views of the session that have
    them are there again afterwards.
    """
    body = validate(sql)
    views = views or {}
    held = {t.name: spark.table(t.name) for t in spark.catalog.listTables() if t.isTemporary and t.name in views} if views else {}
    try:
        for name, df in views.items():
            df.createOrReplaceTempView(name)
        return spark.sql(body)
    finally:
        for name in views:
            if name in held:
                held[name].createOrReplaceTempView(name)
            else:
                spark.catalog.dropTempView(name)


def query_page(
    spark: SparkSession,
    sql: str,
    order_by: Sequence[str | Order] | str,
    page: int = 1,
    page_size: int = MAX_PAGE,
    row_limit: int = MAX_PAGE,
) -> Page:
    """One page of a result along a unique key, with paging figures."""
    return paginate(read_only_query(spark, sql), order_by, page, page_size, row_limit)


def analyze_query(spark: SparkSession, sql: str, rows: int = 10) -> tuple[tuple[DataFrame, DataFrame], Profile]:
    """((column overview, first rows), profile) of a result."""
    result = read_only_query(spark, sql)
    return preview(result, rows), build_profile(result)
