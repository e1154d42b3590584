import pytest

from ridgeline.llm import queries

from .. import oracle


@pytest.fixture(scope="module")
def con():
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equal(spark, con, name):
    oracle.same(spark, con, queries.QUERIES[name], queries.ORACLES[name])


@pytest.mark.parametrize("name, table, columns", [
    ("op1_simhash", "documents", {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"}),
    ("op3_lm_scoring", "documents", {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"}),
    ("op4_telephony_audio", "documents", {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"}),
    ("op6_sentencepiece", "documents", {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}),
    ("op8_quality_rules", "documents", {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"}),
    ("op9_toxicity", "documents", {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}),
])
def test_contracts(spark, name, table, columns):
    df = queries.QUERIES[name](spark, oracle.FOLDER)
    kinds = dict(df.dtypes)
    assert {c: kinds[c] for c in columns} == columns
    assert df.count() == spark.read.parquet(f"{oracle.FOLDER}/{table}.parquet").count()
