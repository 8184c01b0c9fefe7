"""The registered queries: SQL twins, columns, and one result row per input row."""

import duckdb
import pytest
from oracle_check import compare, duck

import __spark_entry__ as entry
from leadspark.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_ppm": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op2_multi_index": {"query_id", "rank", "vec_id", "score"},
    "op3_warc": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
    "op5_simhash": {"doc_id", "fingerprint", "component_id"},
    "op6_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op7_token_counts": {"doc_id", "n_bytes", "n_tokens", "over_limit"},
    "op8_relative_lz": {"doc_id", "n_words", "n_removed", "kept_sha256"},
    "op10_quality": {"doc_id", "held_out", "score", "predicted"},
    "op11_ngram_rules": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op12_negatives": {"anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"},
    "op13_repair": {"conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"},
}
ROWS = {"op3_warc": "pages", "op2_multi_index": None, "op4_mixing": None, "op12_negatives": None, "op13_repair": None}


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twins(spark, name):
    text, _, ok = compare(spark, duck(FOLDER), name, QUERIES[name], ORACLES[name], FOLDER)
    assert ok, text


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_one_row_per_input_row(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert COLUMNS.get(name, set()) <= set(df.columns)
    if of := ROWS.get(name, "documents"):
        assert df.count() == duckdb.sql(f"SELECT count(*) FROM '{FOLDER}/{of}.parquet'").fetchall()[0][0]
