"""Documents to packed training sequences: five stages, each an operator of the pipeline subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sievework.llm.line_dedup import line_dedup
from sievework.llm.mixing import mixed_documents
from sievework.llm.ngram_join import drop_near_copies
from sievework.llm.packing import best_fit_packing
from sievework.llm.quality_rules import keep_good
from sievework.session import materialize, ship_package


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose own rules and whose source's verdict are good."""
    ship_package(spark)
    return keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the lines that an earlier one holds; ``n_chars`` follows the text."""
    ship_package(spark)
    left = line_dedup(docs)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    ship_package(spark)
    return drop_near_copies(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for."""
    ship_package(spark)
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in training sequences."""
    ship_package(spark)
    return best_fit_packing(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("mixture", mixture), ("packing", packing)]
#: Near copies by min-hashing, Newton steps and packing are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
