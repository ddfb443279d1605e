"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontam, exact, lines, manifest, mixing, near, private, quality, spelling, substring, tokens, toxicity, urls

QUERIES = {
    "op1_substring_dedup": substring.op1_substring_dedup,
    "op2_exact_dedup": exact.op2_exact_dedup,
    "op3_benchmark_decontamination": decontam.op3_benchmark_decontamination,
    "op4_line_dedup": lines.op4_line_dedup,
    "op5_source_mixing": mixing.op5_source_mixing,
    "op6_pii_surrogates": private.op6_pii_surrogates,
    "op7_token_counts": tokens.op7_token_counts,
    "op8_url_filters": urls.op8_url_filters,
    "op9_quality_classifier": quality.op9_quality_classifier,
    "op10_ngram_jaccard_join": near.op10_ngram_jaccard_join,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_toxicity": toxicity.op12_toxicity,
    "op13_merkle_manifest": manifest.op13_merkle_manifest,
}

ORACLES: dict[str, str] = {
    "op1_substring_dedup": substring.OP1_SQL,
    "op2_exact_dedup": exact.OP2_SQL,
    "op3_benchmark_decontamination": decontam.OP3_SQL,
    "op4_line_dedup": lines.OP4_SQL,
    "op8_url_filters": urls.OP8_SQL,
    "op11_spelling_variants": spelling.OP11_SQL,
    "op13_merkle_manifest": manifest.OP13_SQL,
}
