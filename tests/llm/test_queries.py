"""The registered queries: one row per row of their table, with the columns agreed on."""

import pytest

from spindrift.llm import queries

COLUMNS = {
    "op1_source_mix": ["doc_id", "size", "source_size", "target", "taken"],
    "op2_html_extract": ["page_id", "url", "text", "n_chars"],
    "op3_ngram_join": ["doc_id", "n_shingles", "component_id"],
    "op4_quality": ["doc_id", "held_out", "score", "predicted"],
    "op5_token_counts": ["doc_id", "n_words", "n_tokens"],
    "op6_substring_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op7_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op8_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op9_license_scan": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    "op10_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op11_importance": ["doc_id", "n_features", "weight", "score", "rank"],
    "op12_chat_format": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op13_conversation_repair": ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"],
}


def test_all_are_registered():
    assert set(queries.QUERIES) == set(COLUMNS) and set(queries.ORACLES) <= set(COLUMNS)


@pytest.mark.parametrize("name", COLUMNS)
def test_rows_and_columns(spark, sf_dir, name):
    out = queries.QUERIES[name](spark, sf_dir)
    assert set(COLUMNS[name]) <= set(out.columns)
    of = {"op2_html_extract": "pages", "op12_chat_format": "conversations", "op13_conversation_repair": "conversations"}.get(name, "documents")
    ids = spark.read.parquet(f"{sf_dir}/{of}.parquet").select(out.columns[0])
    want = [r[0] for r in (ids.distinct() if of == "conversations" else ids).collect()]
    rows = out.collect()
    assert sorted(r[out.columns[0]] for r in rows) == sorted(want + [-1] * (name == "op12_chat_format"))
