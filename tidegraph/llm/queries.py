"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from tidegraph.llm import bpe, jaccard, merkle, packing, pii, quality, repetition, sharding, store, suffixes

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_repetition_coverage": repetition.op2_repetition_coverage,
    "op3_suffix_dedup": suffixes.op3_suffix_dedup,
    "op4_merkle_fingerprints": merkle.op4_merkle_fingerprints,
    "op5_content_store": store.op5_content_store,
    "op6_jaccard_join": jaccard.op6_jaccard_join,
    "op7_pii_boosting": pii.op7_pii_boosting,
    "op8_retrieval_packing": packing.op8_retrieval_packing,
    "op9_bpe_round_trip": bpe.op9_bpe_round_trip,
    "op10_quality_additive": quality.op10_quality_additive,
}
ORACLE_SQL: dict[str, str] = {}
