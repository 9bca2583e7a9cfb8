"""Reading typed values out of text, the way a forgiving table reader does."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# The words a boolean conversion accepts.
TRUE_WORDS = ("true", "1", "yes", "y", "t")
FALSE_WORDS = ("false", "0", "no", "n", "f")

# Cell texts that mean "missing" in a delimited file.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

INTEGER_PATTERN = r"^\s*[+-]?\d+\s*$"
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INFINITY_PATTERN = r"^\s*[+-]?(?i:inf|infinity)\s*$"

# Date layouts tried in turn; pass another list where the data needs one.
DATE_FORMATS = (
    "yyyy-M-d H:m:s",
    "yyyy/M/d",
    "M/d/yyyy",
    "M/d/yyyy H:m:s",
    "d-MMM-yyyy",
    "d MMM yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "yyyyMMdd",
)
_ISO_PATTERN = r"^\s*\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?\s*$"


def parse_number(text: Column) -> Column:
    """A double, or NULL; Java-only spellings such as ``7d`` are not numbers."""
    return F.when(
        text.rlike(NUMBER_PATTERN) | text.rlike(INFINITY_PATTERN), F.trim(text).try_cast("double")
    )


def parse_integer(text: Column) -> Column:
    """A long from a whole number; digits beyond double precision are kept."""
    number = parse_number(text)
    whole = F.when(text.rlike(INTEGER_PATTERN), F.trim(text).try_cast("bigint"))
    return F.coalesce(whole, F.when(number == F.floor(number), number.try_cast("bigint")))


def _shape_of(layout: str) -> str:
    """A pattern every text of a date layout fits; failed parses are costly, so they are sorted out first."""
    pattern = ""
    for run in re.findall(r"([A-Za-z])(\1*)|([^A-Za-z])", layout):
        letter, more, mark = run
        if mark:
            pattern += re.escape(mark)
        elif letter == "M" and len(more) >= 2:
            pattern += "[A-Za-z]{3,9}"
        elif more:
            pattern += rf"\d{{{len(more) + 1}}}"
        else:
            pattern += r"\d{1,2}"
    return f"^{pattern}$"


def parse_timestamp(text: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    trimmed = F.trim(text)
    parsed = F.when(trimmed.rlike(_ISO_PATTERN), trimmed.try_cast("timestamp"))
    tried = [
        F.when(trimmed.rlike(_shape_of(f)) if re.fullmatch(r"[yMdHms\W]+", f) else F.lit(True), F.try_to_timestamp(trimmed, F.lit(f)))
        for f in formats
    ]
    if formats is not DATE_FORMATS:
        return F.coalesce(parsed, *tried)
    # All of these layouts hold a digit and are short: most texts are settled by this test alone.
    likely = (F.length(trimmed) <= 64) & trimmed.rlike(r"\d")
    return F.when(likely, F.coalesce(parsed, *tried))


def parse_boolean(text: Column) -> Column:
    word = F.lower(F.trim(text))
    return F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False))


def value_kind(text: Column) -> Column:
    """The narrowest kind a text cell reads as: int, float, bool, timestamp or text."""
    return (
        F.when(text.rlike(INTEGER_PATTERN), F.lit("int"))
        .when(parse_number(text).isNotNull(), F.lit("float"))
        .when(F.lower(F.trim(text)).isin("true", "false"), F.lit("bool"))
        .when(F.when(text.rlike(_ISO_PATTERN), F.trim(text).try_cast("timestamp")).isNotNull(), F.lit("timestamp"))
        .otherwise(F.lit("text"))
    )
