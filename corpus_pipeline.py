"""Corpus pipeline: each stage is one operator over all documents its predecessor kept.

Stage functions take (spark, docs, sf_dir); all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convolake.deploy import ship
from convolake.llm import bpe_automaton, pii, quality, simhash, winnow
from convolake.llm.common import cut, drop

#: Surrogates are drawn with it; the tables of the checks are public, so it is no secret here.
PII_KEY = "key of the public tables"


def _shipped(stage):
    """The stage, its package given to the executors first."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier accepts (score 0.5 or more)."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group of copies and near copies: five-word shingles, similarity 0.8."""
    return simhash.one_of_each(docs, simhash.similar_groups(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is text of the benchmark."""
    return winnow.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their private data replaced by surrogates; n_chars counts the new text."""
    out = pii.replace_pii(docs, PII_KEY, count_col=None)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the text they decode to."""
    return bpe_automaton.encode(docs)


STAGES = [
    ("quality", keep_good),
    ("near_dedup", drop_copies),
    ("decontaminate", drop_contaminated),
    ("pii", replace_private),
    ("bpe", encode),
]
STAGES = [(name, _shipped(stage)) for name, stage in STAGES]

#: The fitted classifier and the tokenizer have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again, over sf_dir's documents."""
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
        if written is not None:
            drop(written)
        written = docs
    return docs
