"""The queries of this folder and their SQL twins."""

from __future__ import annotations

from terrahaz.llm import (block_repeats, length_buckets, line_bitmaps, line_rules, merkle_manifest, odd_sketch_dedup,
                          phrase_index, slot_shards, subword_toxicity, suffix_repeats, surrogates,
                          url_filter, whitening)

QUERIES = {
    "op1_subword_toxicity": subword_toxicity.op1_subword_toxicity,
    "op2_line_rules": line_rules.op2_line_rules,
    "op3_slot_shards": slot_shards.op3_slot_shards,
    "op4_length_buckets": length_buckets.op4_length_buckets,
    "op5_odd_sketch_dedup": odd_sketch_dedup.op5_odd_sketch_dedup,
    "op6_surrogates": surrogates.op6_surrogates,
    "op7_suffix_repeats": suffix_repeats.op7_suffix_repeats,
    "op8_block_repeats": block_repeats.op8_block_repeats,
    "op9_phrase_index": phrase_index.op9_phrase_index,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_line_bitmaps": line_bitmaps.op11_line_bitmaps,
    "op12_embedding_whitening": whitening.op12_embedding_whitening,
    "op13_merkle_manifest": merkle_manifest.op13_merkle_manifest,
}
ORACLES = {
    "op2_line_rules": line_rules.SQL,
    "op8_block_repeats": block_repeats.SQL,
    "op9_phrase_index": phrase_index.SQL,
    "op10_url_filter": url_filter.SQL,
    "op11_line_bitmaps": line_bitmaps.SQL,
    "op13_merkle_manifest": merkle_manifest.SQL,
}
