"""The numbered queries over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sievework.llm.hard_negatives import hard_negatives
from sievework.llm.line_dedup import line_dedup
from sievework.llm.merkle import folded, hexed, merkle_manifest, proof_digest
from sievework.llm.mixing import mix
from sievework.llm.near_vectors import near_vectors
from sievework.llm.ngram_join import ngram_join
from sievework.llm.packing import best_fit_packing
from sievework.llm.quality_rules import quality_rules
from sievework.llm.secret_scan import secret_scan
from sievework.llm.tool_calls import link_calls, message_json
from sievework.llm.toxicity import toxicity
from sievework.llm.url_filter import RULES, url_filter
from sievework.llm.vector_search import search
from sievework.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship_package(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return quality_rules(docs).select("doc_id", *counts, "base_failed", "kept")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "rate")


#: What a user's turn asks of the assistant, as a tool.
REPLY = {"reply": {"message": ("string", True), "turn": ("integer", True)}}


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn calls the tool ``reply``, needs the user turn two before it, and gets the next assistant turn.

    Other messages are rows of kind ``message``.
    """
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")

    def named(turn):
        return F.concat(F.lit("c"), turn.cast("string"))

    turn = F.col("turn")
    calls = talks.filter("role = 'user'").select(
        "conv_id", "turn", named(turn).alias("call_id"), F.lit("reply").alias("name"),
        F.to_json(F.struct("turn", F.col("text").alias("message"))).alias("arguments"), F.array(named(turn - 2)).alias("depends_on"),
    )
    results = talks.filter("role = 'assistant'").select("conv_id", "turn", named(turn - 1).alias("call_id"), F.col("text").alias("content"))
    linked = link_calls(calls, results, REPLY)
    plain = talks.filter("role is null or role not in ('user', 'assistant')").select(
        "conv_id", F.lit(None).cast("string").alias("call_id"), F.lit("message").alias("kind"), "turn", F.lit(None).cast("long").alias("result_turn"),
        F.col("turn").alias("order_turn"), F.lit(0).alias("order_level"), F.array().cast("array<string>").alias("errors"),
        message_json("role", "text").alias("json"),
    )
    rows = linked.unionByName(plain)
    return rows.withColumn("errors", F.array_join("errors", "; "))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return url_filter(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return best_fit_packing(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secret_scan(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs, digest_only=True).select("doc_id", "lines.*")


def _remainder():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(_remainder() != 1)
    scored = toxicity(docs, labels)
    held_out = F.coalesce(_remainder() == 1, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, F.col("vec_id") % 100 == 0)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows, label, F.col("vec_id") % 100 == 0)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of ``documents`` by language, checked after tampering with every seventh ``n_chars``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    tampered = {"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    made = merkle_manifest(docs, ("doc_id", "source", "lang", "n_chars", "text"), "doc_id", "lang", tampered)
    made = made.withColumn("folded_root", hexed(folded(F.col("altered"), F.col("path"))))
    return made.select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


_ALL = (
    op1_quality_rules, op2_ngram_join, op3_mixing, op4_tool_calls, op5_url_filter, op6_packing, op7_secret_scan, op8_line_dedup,
    op9_toxicity, op10_vector_search, op11_hard_negatives, op12_merkle_manifest, op13_near_vectors,
)


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in _ALL}
