"""Text expressions; all but stemming run inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from sievework.functions.columns import WHITESPACE, words
from sievework.functions.stemming import stem

# The ASCII punctuation marks.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# The usual English stop-word list.
STOP_WORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves "
    "he him his himself she she's her hers herself it it's its itself they them their theirs themselves "
    "what which who whom this that that'll these those am is are was were be been being have has had "
    "having do does did doing a an the and but if or because as until while of at by for with about "
    "against between into through during before after above below to from up down in out on off over "
    "under again further then once here there when where why how all any both each few more most other "
    "some such no nor not only own same so than too very s t can will just don don't should should've "
    "now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn "
    "hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn "
    "shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
).split()

# Penn Treebank tokenization as (pattern, replacement), applied in this order.
_TREEBANK = (
    (r'^"', "`` "),
    (r"(``)", " $1 "),
    (r"([ (\[{<])(\"|'{2})", "$1 `` "),
    (r"([:,])([^\d])", " $1 $2"),
    (r"([:,])$", " $1 "),
    (r"\.\.\.", " ... "),
    (r"[;@#$%&]", " $0 "),
    (r"([^.])(\.)([\])}>\"']*)\s*$", "$1 $2$3 "),
    (r"[?!]", " $0 "),
    (r"([^'])' ", "$1 ' "),
    (r"[\]\[(){}<>]", " $0 "),
    (r"--", " -- "),
    (r"^|$", " "),
    (r'"', " '' "),
    (r"(\S)('')", "$1 $2 "),
    (r"([^' ])('[sS]|'[mM]|'[dD]|') ", "$1 $2 "),
    (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", "$1 $2 "),
    (r"(?i)\b(can)(not)\b", " $1 $2 "),
    (r"(?i)\b(d)('ye)\b", " $1 $2 "),
    (r"(?i)\b(gim)(me)\b", " $1 $2 "),
    (r"(?i)\b(gon)(na)\b", " $1 $2 "),
    (r"(?i)\b(got)(ta)\b", " $1 $2 "),
    (r"(?i)\b(lem)(me)\b", " $1 $2 "),
    (r"(?i)\b(more)('n)\b", " $1 $2 "),
    (r"(?i)\b(wan)(na)\b", " $1 $2 "),
    (r"(?i) ('t)(is|was)\b", " $1 $2 "),
)
# A sentence ends at . ! or ? before white space and a capital letter or digit.
_SENTENCE_END = r"(?U)(?<=[.!?])\s+(?=[\p{Lu}\d\"'(\[])"


def as_text(column: Column) -> Column:
    """The column as text; missing becomes the empty string."""
    return F.coalesce(column.cast("string"), F.lit(""))


def remove_punctuation(text: Column) -> Column:
    return F.translate(text, PUNCTUATION, "")


def remove_numbers(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)\\d+", "")


def collapse_spaces(text: Column) -> Column:
    edges = "(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$"
    return F.regexp_replace(F.regexp_replace(text, edges, ""), WHITESPACE, " ")


def remove_stop_words(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    known = list(stop_words)
    return F.array_join(F.filter(words(text), lambda w: ~F.lower(w).isin(known)), " ")


def tokenize(text: Column) -> Column:
    """Word and punctuation tokens: sentences first, then Treebank rules within each."""

    def split_sentence(sentence: Column) -> Column:
        out = sentence
        for pattern, replacement in _TREEBANK:
            out = F.regexp_replace(out, pattern, replacement)
        return words(out)

    return F.flatten(F.transform(F.split(text, _SENTENCE_END), split_sentence))


@F.pandas_udf(T.StringType())
def stem_words(text: pd.Series) -> pd.Series:
    """Each word stemmed, joined by single spaces; a word is stemmed once per batch."""
    known: dict[str, str] = {}

    def one(value: str) -> str:
        found = value.split()
        for word in found:
            if word not in known:
                known[word] = stem(word)
        return " ".join([known[w] for w in found])

    return text.map(one)


def terms(text: Column) -> Column:
    """Lower-case words of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
