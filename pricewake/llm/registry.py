"""Registered queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from pricewake.llm import (
    decontaminate,
    filter_audit,
    langid,
    merges,
    ngram_join,
    packing,
    quality,
    secrets,
    sql,
    tokenfiles,
    toxicity,
    turn_trie,
    vectors,
    wordpieces,
)

QUERIES = {
    "op1_ngram_jaccard_join": ngram_join.op1_ngram_jaccard_join,
    "op2_packing": packing.op2_packing,
    "op3_token_files": tokenfiles.op3_token_files,
    "op4_language_id": langid.op4_language_id,
    "op5_token_counts": wordpieces.op5_token_counts,
    "op6_embedding_dedup": vectors.op6_embedding_dedup,
    "op7_benchmark_decontamination": decontaminate.op7_benchmark_decontamination,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_secret_scans": secrets.op9_secret_scans,
    "op10_quality": quality.op10_quality,
    "op11_filter_interaction_audit": filter_audit.op11_filter_interaction_audit,
    "op12_byte_bpe": merges.op12_byte_bpe,
    "op13_conversation_trie": turn_trie.op13_conversation_trie,
}

ORACLE_SQL = {
    "op1_ngram_jaccard_join": sql.NGRAM_JACCARD_JOIN,
    "op7_benchmark_decontamination": sql.BENCHMARK_DECONTAMINATION,
    "op9_secret_scans": sql.SECRET_SCANS,
    "op11_filter_interaction_audit": sql.FILTER_INTERACTION_AUDIT,
    "op13_conversation_trie": sql.CONVERSATION_TRIE,
}
