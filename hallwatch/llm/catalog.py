"""Queries of this subpackage and, where SQL can express them, their checks."""

from __future__ import annotations

from hallwatch.llm import (best_fit_packing, bpe, chat_examples, importance_resampling, language_id, license_scan, ngram_join, quality_rules, rotation_codes, substring_dedup, suffix_tree_lm,
                           token_counts, wavelet_fim)

QUERIES = {
    "op1_ngram_jaccard_join": ngram_join.op1_ngram_jaccard_join,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_language_id": language_id.op3_language_id,
    "op4_best_fit_packing": best_fit_packing.op4_best_fit_packing,
    "op5_bpe_encoding": bpe.op5_bpe_encoding,
    "op6_license_scan": license_scan.op6_license_scan,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_lm_scoring": suffix_tree_lm.op8_lm_scoring,
    "op9_chat_formatting": chat_examples.op9_chat_formatting,
    "op10_embedding_near_dedup": rotation_codes.op10_embedding_near_dedup,
    "op11_wavelet_fim": wavelet_fim.op11_wavelet_fim,
    "op12_token_counts": token_counts.op12_token_counts,
    "op13_importance_resampling": importance_resampling.op13_importance_resampling,
}

SQL = {
    "op1_ngram_jaccard_join": ngram_join.OP1_SQL,
    "op7_substring_dedup": substring_dedup.OP7_SQL,
    "op9_chat_formatting": chat_examples.OP9_SQL,
    "op11_wavelet_fim": wavelet_fim.OP11_SQL,
    "op13_importance_resampling": importance_resampling.OP13_SQL,
}
