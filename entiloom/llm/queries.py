"""Queries of this subpackage and, where DuckDB's SQL can express them, their oracles."""

from __future__ import annotations

from . import bpe, decontamination, hard_negatives, importance, near_dups, oracles, parity_join, pii, quality_kernel, quality_rules, sharding, suffix_dedup, token_files, toxicity


def queries() -> dict:
    return {
        "op1_sharding": sharding.op1_sharding,
        "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
        "op3_bpe": bpe.op3_bpe,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_pii": pii.op5_pii,
        "op6_token_files": token_files.op6_token_files,
        "op7_decontamination": decontamination.op7_decontamination,
        "op8_quality": quality_kernel.op8_quality,
        "op9_quality_rules": quality_rules.op9_quality_rules,
        "op10_near_dups": near_dups.op10_near_dups,
        "op11_hard_negatives": hard_negatives.op11_hard_negatives,
        "op12_jaccard_join": parity_join.op12_jaccard_join,
        "op13_importance": importance.op13_importance,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
