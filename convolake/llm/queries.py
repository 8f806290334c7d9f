"""The opN queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash

    return simhash.near_dedup(_table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix_dedup

    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), keep_bytes=False, passages=True)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_counts

    return token_counts.token_counts(_table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe_automaton

    return bpe_automaton.encode(_table(spark, sf_dir, "documents"), keep_ids=False)


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_store
    from .common import scratch

    folder = f"{scratch(spark)}/token_store-{uuid.uuid4().hex}"
    token_store.write(_table(spark, sf_dir, "documents"), folder)
    return token_store.read(spark, folder, keep_ids=False)


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import embeddings

    return embeddings.near_dedup(_table(spark, sf_dir, "embeddings"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat
    from .common import cut

    said = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digests(cut(chat.windows(rows)))


def op9_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import winnow

    out = winnow.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    # the tables are public, so the key is no secret here
    return pii.replace_pii(_table(spark, sf_dir, "documents"), "key of the public tables").select("doc_id", "n_entities", "text")


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import importance

    out = importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import repair

    return repair.repaired_report(_table(spark, sf_dir, "conversations"))


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import neighbours

    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {f.__name__: f for f in (op1_simhash, op2_quality, op3_suffix_dedup, op4_token_counts, op5_bpe, op6_token_store, op7_embeddings, op8_chat, op9_winnow, op10_pii, op11_importance, op12_repair, op13_neighbours)}

ORACLE_SQL: dict[str, str] = {}
