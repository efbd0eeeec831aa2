"""Queries of the training-text operators, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import op1_substring_dedup, op2_language, op3_quality, op4_bpe, op5_fingerprints, op6_toxicity, op7_packing, op8_html, op9_ngram_join, op10_exact_dedup, op11_conversations, op12_mixing, op13_divergence

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup.op1_substring_dedup,
    "op2_language": op2_language.op2_language,
    "op3_quality": op3_quality.op3_quality,
    "op4_bpe": op4_bpe.op4_bpe,
    "op5_fingerprints": op5_fingerprints.op5_fingerprints,
    "op6_toxicity": op6_toxicity.op6_toxicity,
    "op7_packing": op7_packing.op7_packing,
    "op8_html": op8_html.op8_html,
    "op9_ngram_join": op9_ngram_join.op9_ngram_join,
    "op10_exact_dedup": op10_exact_dedup.op10_exact_dedup,
    "op11_conversations": op11_conversations.op11_conversations,
    "op12_mixing": op12_mixing.op12_mixing,
    "op13_divergence": op13_divergence.op13_divergence,
}

ORACLES: dict[str, str] = {
    "op10_exact_dedup": op10_exact_dedup.ORACLE,
    "op13_divergence": op13_divergence.ORACLE,
}
