"""Registered queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, hyperlang, mixing, nearest, perplexity, prefix_tree, secrets, token_counts, toxicity, warc

QUERIES = {
    "op1_language_id": hyperlang.op1_language_id,
    "op2_byte_bpe": bpe.op2_byte_bpe,
    "op3_warc": warc.op3_warc,
    "op4_quality_perplexity": perplexity.op4_quality_perplexity,
    "op5_nearest": nearest.op5_nearest,
    "op6_token_attribution": token_counts.op6_token_attribution,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_ngram_jaccard": prefix_tree.op8_ngram_jaccard,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_mix_sources": mixing.op10_mix_sources,
}

ORACLES = {
    "op3_warc": warc.ORACLE,
    "op8_ngram_jaccard": prefix_tree.ORACLE,
    "op10_mix_sources": mixing.ORACLE,
}
