"""Queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import (
    byte_bpe, embedding_dedup, filter_audit, line_dedup, merkle_manifest, near_dedup, packed_ids, quality_rules, repeat_removal, rotated_codes, source_mix, toxicity,
    url_filter,
)

QUERIES = {
    "op1_repeat_removal": repeat_removal.op1_repeat_removal,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_byte_bpe": byte_bpe.op3_byte_bpe,
    "op4_source_mix": source_mix.op4_source_mix,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_rotated_codes": rotated_codes.op7_rotated_codes,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_packed_ids": packed_ids.op10_packed_ids,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_merkle_manifest": merkle_manifest.op12_merkle_manifest,
    "op13_embedding_dedup": embedding_dedup.op13_embedding_dedup,
}

ORACLE_SQL = {
    "op4_source_mix": source_mix.OP4_SQL,
    "op5_url_filter": url_filter.OP5_SQL,
    "op7_rotated_codes": rotated_codes.OP7_SQL,
    "op11_filter_audit": filter_audit.OP11_SQL,
    "op12_merkle_manifest": merkle_manifest.OP12_SQL,
    "op13_embedding_dedup": embedding_dedup.OP13_SQL,
}
