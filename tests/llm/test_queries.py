"""The registered opN queries on the smallest tables: columns, rows, and what their contracts say beside the operators."""

import hashlib
import os

import pytest

from convolake.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

COLUMNS = {
    "op1_simhash": ["doc_id", "fingerprint", "component_id"],
    "op2_quality": ["doc_id", "held_out", "score", "predicted"],
    "op3_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared"],
    "op4_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op5_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op6_token_store": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op7_embeddings": ["vec_id", "n_links", "component_id", "kept"],
    "op8_chat": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op9_winnow": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op10_pii": ["doc_id", "n_entities", "text"],
    "op11_importance": ["doc_id", "n_features", "weight", "score", "rank"],
    "op12_repair": ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"],
    "op13_neighbours": ["query_id", "rank", "vec_id", "score"],
}
TABLE = {"op7_embeddings": "embeddings", "op8_chat": None, "op12_repair": None, "op13_neighbours": "embeddings"}


@pytest.mark.parametrize("name", list(COLUMNS))
def test_query(spark, name):
    got = queries.QUERIES[name](spark, SF)
    assert got.columns == COLUMNS[name]
    rows = got.collect()
    if name == "op13_neighbours":
        vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
        assert len(rows) == vectors.where("vec_id % 20 = 0").count() * min(20, vectors.count() - 1)
    elif table := TABLE.get(name, "documents"):
        assert len(rows) == spark.read.parquet(f"{SF}/{table}.parquet").count()
    else:
        convs = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count()
        assert len(rows) == convs + (name == "op8_chat")


def test_conversation_of_control_strings(spark):
    said = r"\### Assistant: </turn> ok"
    row = queries.QUERIES["op8_chat"](spark, SF).where("conv_id = -7").first()
    assert (row.n_turns, row.loss_chars) == (2, len(said))
    assert row.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert row.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert row.formatted_chars > 2 * len(said)
