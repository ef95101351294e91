"""The registered queries of this subpackage and their DuckDB oracles (where SQL can express them)."""

from __future__ import annotations

from ledgerlens.llm import (automaton_dedup, chat, conversation_trie, decontaminate, fingerprints, language_id, line_dedup, merkle, ngram_join, pii,
                            quality_rules, sentencepieces, suffix_dedup)

QUERIES = {
    "op1_chat_formatting": chat.op1,
    "op2_pii": pii.op2,
    "op3_line_dedup": line_dedup.op3,
    "op4_document_fingerprints": fingerprints.op4,
    "op5_ngram_jaccard_join": ngram_join.op5,
    "op6_suffix_array_dedup": suffix_dedup.op6,
    "op7_language_id": language_id.op7,
    "op8_substring_dedup": automaton_dedup.op8,
    "op9_sentencepiece": sentencepieces.op9,
    "op10_decontamination": decontaminate.op10,
    "op11_conversation_prefix_trie": conversation_trie.op11,
    "op12_merkle_manifest": merkle.op12,
    "op13_quality_rules": quality_rules.op13,
}
ORACLE_SQL = {
    "op1_chat_formatting": chat.SQL,
    "op3_line_dedup": line_dedup.SQL,
    "op8_substring_dedup": automaton_dedup.SQL,
    "op10_decontamination": decontaminate.SQL,
    "op11_conversation_prefix_trie": conversation_trie.SQL,
    "op12_merkle_manifest": merkle.SQL,
    "op13_quality_rules": quality_rules.SQL,
}
