"""The queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from . import brown_lm, decontamination, one_bit_search, pii, quality_crf, sentencepiece_nbest, simhash, spelling_variants, substring_dedup, token_alignment, token_counts, topk_search, toxicity

QUERIES = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_simhash_near_dedup": simhash.op2_simhash_near_dedup,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_quality_crf": quality_crf.op4_quality_crf,
    "op5_sentencepiece": sentencepiece_nbest.op5_sentencepiece,
    "op6_pii": pii.op6_pii,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_topk_search": topk_search.op8_topk_search,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_brown_lm": brown_lm.op10_brown_lm,
    "op11_spelling_variants": spelling_variants.op11_spelling_variants,
    "op12_one_bit_search": one_bit_search.op12_one_bit_search,
    "op13_token_alignment": token_alignment.op13_token_alignment,
}
ORACLES: dict[str, str] = {"op7_substring_dedup": substring_dedup.ORACLE, "op8_topk_search": topk_search.ORACLE}
