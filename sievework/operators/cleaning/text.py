"""Text operations.  A missing text counts as empty."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from sievework.functions.columns import put, quoted, words
from sievework.functions.frequencies import attach
from sievework.functions.text import (
    STOP_WORDS,
    as_text,
    collapse_spaces,
    remove_numbers,
    remove_punctuation,
    remove_stop_words,
    stem_words,
    terms,
    tokenize,
)
from sievework.operators.cleaning.base import Operation
from sievework.errors import OperationError
from sievework.session import materialize

LEMMA_ROWS = 1_000_000
_SALTS = 64
#: Changes of words up to which they travel to the texts, not the words to them.
_BROADCAST_ROWS = 500_000
#: Texts that tell which words are frequent; that shapes tasks, not the result.
_SAMPLED_TEXTS = 10_000
_FREQUENT_WORDS = 1_000
_FREQUENT_TEXTS = 1_000
_MOST_TERMS = 5_000


def _replace(key: str, label: str, change: Callable[[Column, dict], Column]) -> Operation:
    def value(df: DataFrame, name: str, params) -> Column:
        return change(as_text(quoted(name)), params)

    return Operation(
        key,
        label,
        lambda df, c, p, f: put(df, c, value(df, c, p)),
        affected=lambda df, c, p, f: F.count_if(value(df, c, p) != as_text(quoted(c))),
    )


def lemmatize(df: DataFrame, name: str, lemmas: DataFrame, bound: int = LEMMA_ROWS) -> DataFrame:
    """Replace each word by its lemma; ``lemmas`` has columns (word, lemma).

    Texts are taken apart into distinct words, which are looked up and put together
    again by position; a digest stands for the text, so words travel alone.  Changes of
    ordinary size (``bound``, some hundred thousand in any case) travel to the words.
    Beyond, words travel to them, and only what is found travels on to its text.
    """
    # A word with several lemmas gets the smallest, however large the dictionary is.
    changes = lemmas.groupBy("word").agg(F.min("lemma").alias("lemma")).filter(F.col("word") != F.col("lemma"))
    changes = materialize(changes, "lemmas")  # counted, and read where words are
    rows = changes.count()
    marked = df.withColumn("__t", F.unhex(F.md5(as_text(quoted(name)))))
    texts = marked.groupBy("__t").agg(F.count(F.lit(1)).alias("n"))
    own = marked.select("__t", F.explode(F.array_distinct(words(as_text(quoted(name))))).alias("word"))
    if rows <= max(bound, _BROADCAST_ROWS):
        matched = own.join(F.broadcast(changes), "word")
    else:
        # A salt spreads a frequent word over many tasks; its lemma row is repeated to match.
        sampled = marked.sample(min(1.0, _SAMPLED_TEXTS / max(1, marked.count())), seed=5)
        counts = sampled.select(F.explode(F.array_distinct(words(as_text(quoted(name))))).alias("word")).groupBy("word").count()
        often = [r["word"] for r in counts.orderBy(F.col("count").desc()).limit(_FREQUENT_WORDS).collect()]
        hot = F.col("word").isin(often)
        salted = own.withColumn("salt", F.when(hot, F.pmod(F.xxhash64("__t"), F.lit(_SALTS)).cast("int")).otherwise(F.lit(0)))
        salts = F.when(hot, F.sequence(F.lit(0), F.lit(_SALTS - 1))).otherwise(F.array(F.lit(0)))
        matched = salted.join(changes.withColumn("salt", F.explode(salts)), ["word", "salt"])
    # One map per text, as large as the text has words; copies of a text bring the same ones.
    found = matched.groupBy("__t").agg(F.map_from_entries(F.collect_set(F.struct("word", "lemma"))).alias("value"))
    lookup = found.join(texts, "__t").select(F.col("__t").alias("key"), "value", "n")
    text = F.struct(as_text(quoted(name)).alias("t"), *[quoted(c).alias(f"c{i}") for i, c in enumerate(df.columns)])
    joined = attach(marked.select("__t", text.alias("__row")), "__t", lookup, "__m", _FREQUENT_TEXTS)
    parts = words(F.col("__row.t"))
    value = F.array_join(F.transform(parts, lambda w: F.coalesce(F.try_element_at("__m", w), w)), " ")
    return joined.select(
        [value.alias(c) if c == name else F.col(f"__row.c{i}").alias(c) for i, c in enumerate(df.columns)]
    )


def _lemmatize(df: DataFrame, name: str, params, facts) -> DataFrame:
    lemmas = params.get("lemmas")
    if lemmas is None:
        raise OperationError("Lemmatization needs params.lemmas, a table of (word, lemma).")
    if isinstance(lemmas, dict):
        lemmas = df.sparkSession.createDataFrame(list(lemmas.items()), "word string, lemma string")
    return lemmatize(df, name, lemmas, int(params.get("lemma_rows", LEMMA_ROWS)))


def vocabulary(df: DataFrame, name: str, size: int = 50) -> list[str]:
    """The ``size`` most frequent terms (alphabetical on ties), in alphabetical order."""
    counted = (
        df.select(F.explode(terms(as_text(quoted(name)))).alias("term"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), "term")
        .limit(size)
    )
    return sorted(r["term"] for r in counted.collect())


def _kept(name: str, known: list[str]) -> Column:
    return F.filter(terms(as_text(quoted(name))), lambda t: t.isin(known))


def _with_counts(df: DataFrame, name: str, known: list[str]) -> tuple[DataFrame, list[Column]]:
    """Counts per vocabulary term, row by row.

    Each vocabulary term of a text becomes one character; how much shorter the
    line gets without a character tells how often its term occurs.
    """
    letters = [chr(0x4E00 + i) for i in range(len(known))]  # any distinct characters will do
    places = F.array(*[F.lit(t) for t in known])
    letter = lambda t: F.substring(F.lit("".join(letters)), F.array_position(places, t).cast("int"), F.lit(1))
    line = F.array_join(F.transform(_kept(name, known), letter), "") if known else F.lit("")
    base = df.withColumn("__line", line)
    full = F.length("__line")
    return base, [full - F.length(F.replace(F.col("__line"), F.lit(c), F.lit(""))) for c in letters]


def _size(params) -> int:
    size = int(params.get("max_features", 50))
    if not 0 < size <= _MOST_TERMS:
        raise OperationError(f"params.max_features must be 1 to {_MOST_TERMS}: every term becomes a column.")
    return size


def _learn_terms(df: DataFrame, name: str, params) -> dict:
    return {"terms": vocabulary(df, name, _size(params))}


def _learn_idf(df: DataFrame, name: str, params) -> dict:
    """Vocabulary, rows with each of its terms and all rows, from one pass over the texts.

    A row's terms are sorted, so that a term's first occurrence counts the row; a row
    without a term's name counts the rows.
    """
    ordered = df.select(F.array_sort(terms(as_text(quoted(name)))).alias("sorted"))
    first = lambda t, i: F.struct(t.alias("term"), ((i == 0) | (F.get("sorted", i - 1) != t)).cast("int").alias("first"))
    row = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(1).alias("first")))
    cells = ordered.select(F.explode(F.concat(row, F.coalesce(F.transform("sorted", first), F.array().cast("array<struct<term:string,first:int>>")))).alias("cell"))
    counted = cells.groupBy("cell.term").agg(F.count(F.lit(1)).alias("n"), F.sum("cell.first").alias("rows"))
    # The row without a term comes first, then the most frequent terms.
    top = counted.orderBy(F.col("term").isNotNull(), F.col("n").desc(), "term").limit(_size(params) + 1).collect()
    rows = next((r["n"] for r in top if r["term"] is None), 0)
    found = {r["term"]: r["rows"] for r in top if r["term"] is not None}
    known = sorted(found)
    # ln((1 + rows) / (1 + rows with the term)) + 1
    return {"terms": known, "weights": [math.log((1 + rows) / (1 + found[t])) + 1 for t in known]}


def _bag(df: DataFrame, name: str, params, facts) -> DataFrame:
    base, counts = _with_counts(df, name, facts["terms"])
    others = [quoted(c) for c in df.columns if c != name]
    return base.select(
        *others, *[c.cast("long").alias(f"{name}_bow_{t}") for t, c in zip(facts["terms"], counts)]
    )


def _tfidf(df: DataFrame, name: str, params, facts) -> DataFrame:
    base, counts = _with_counts(df, name, facts["terms"])
    others = [quoted(c) for c in df.columns if c != name]
    weighted = base.select(
        *others, *[(c * F.lit(w)).alias(f"__w{i}") for i, (c, w) in enumerate(zip(counts, facts["weights"]))]
    )
    squares = F.lit(0.0)
    for i in range(len(counts)):
        squares = squares + F.col(f"__w{i}") * F.col(f"__w{i}")
    scaled = weighted.withColumn("__length", F.sqrt(squares))
    return scaled.select(
        *others,
        *[
            F.coalesce(F.try_divide(F.col(f"__w{i}"), F.col("__length")), F.lit(0.0)).alias(f"{name}_tfidf_{t}")
            for i, t in enumerate(facts["terms"])
        ],
    )


def _rows(df, name, params, facts) -> Column:
    return F.count(F.lit(1))


def _term_columns(df, name, facts) -> int:
    return len(facts["terms"])


OPERATIONS = [
    _replace("text.lowercase", "Lowercase", lambda t, p: F.lower(t)),
    _replace("text.remove_punctuation", "Remove Punctuation", lambda t, p: remove_punctuation(t)),
    _replace("text.remove_numbers", "Remove Numbers", lambda t, p: remove_numbers(t)),
    _replace(
        "text.remove_stopwords",
        "Remove Stop Words",
        lambda t, p: remove_stop_words(t, p.get("stop_words", STOP_WORDS)),
    ),
    _replace("text.remove_extra_spaces", "Remove Extra Spaces", lambda t, p: collapse_spaces(t)),
    Operation(
        "text.tokenize",
        "Tokenization",
        lambda df, c, p, f: put(df, c, tokenize(as_text(quoted(c)))),
        affected=_rows,
    ),
    Operation("text.lemmatize", "Lemmatization", _lemmatize, learn=lambda df, c, p: {}, affected=_rows),
    _replace("text.stem", "Stemming", lambda t, p: stem_words(t)),
    Operation(
        "text.tfidf",
        "TF-IDF Vectorization",
        _tfidf,
        learn=_learn_idf,
        affected=_rows,
        columns_changed=_term_columns,
    ),
    Operation(
        "text.bow",
        "Bag of Words",
        _bag,
        learn=_learn_terms,
        affected=_rows,
        columns_changed=_term_columns,
    ),
]
