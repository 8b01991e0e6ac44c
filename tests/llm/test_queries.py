"""The registered queries: columns and types as agreed, one row for each document, SQL where there is some."""

import pytest
from oracle import compare, connect

from sparrowdoc.llm import queries

QUERIES, SQL = queries.queries(), queries.oracle_sql()
COLUMNS = {
    "op1_minhash_near_dedup": "doc_id bigint, class_id bigint, class_size bigint",
    "op2_chat_formatting": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op3_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op4_exact_topk": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op5_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op6_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op7_lm_scoring": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op8_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
    "op9_suffix_array_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op10_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op11_license_scans": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op12_periodic_runs": "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string",
    "op13_phrase_collocations": "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
}


def test_all():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)] and set(COLUMNS) == set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    have = dict(df.dtypes)
    for column in COLUMNS[name].split(", "):
        c, kind = column.split()
        assert have[c] == kind
    if name in SQL:
        assert compare(df, connect(sf), SQL[name])
    elif name != "op5_packing":
        assert df.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
