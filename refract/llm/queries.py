"""The registered queries of this folder, one for each operator."""

from __future__ import annotations

from refract.llm import (alignment, exact_dedup, extraction, infill, langid, mixing, near_vectors, ngram_join, packing,
                         passages, secrets, sharding, toxicity)

QUERIES = {
    "op1_language_id": langid.query,
    "op2_source_mixing": mixing.query,
    "op3_secret_scan": secrets.query,
    "op4_embedding_near_dedup": near_vectors.query,
    "op5_best_fit_packing": packing.query,
    "op6_exact_dedup": exact_dedup.query,
    "op7_html_extraction": extraction.query,
    "op8_ngram_jaccard_join": ngram_join.query,
    "op9_substring_dedup": passages.query,
    "op10_toxicity": toxicity.query,
    "op11_fill_in_middle": infill.query,
    "op12_weighted_hash_tree": sharding.query,
    "op13_cross_tokenizer_alignment": alignment.query,
}

ORACLE = {
    "op4_embedding_near_dedup": near_vectors.ORACLE,
    "op6_exact_dedup": exact_dedup.ORACLE,
    "op8_ngram_jaccard_join": ngram_join.ORACLE,
    "op11_fill_in_middle": infill.ORACLE,
    "op12_weighted_hash_tree": sharding.ORACLE,
}
