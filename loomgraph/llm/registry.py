"""The queries of this subpackage and, where SQL can express them, the same in DuckDB SQL."""

from __future__ import annotations

from loomgraph.llm import decontam, licensescan, lm, mixing, neardup, oracles, quality, secretscan, sharding, suffixes, tokens


def queries() -> dict:
    return {
        "op1_license_scans": licensescan.op1_license_scans,
        "op2_token_ids": tokens.op2_token_ids,
        "op3_sharding": sharding.op3_sharding,
        "op4_quality_rules": quality.op4_quality_rules,
        "op5_suffix_dedup": suffixes.op5_suffix_dedup,
        "op6_lm_scoring": lm.op6_lm_scoring,
        "op7_mixing": mixing.op7_mixing,
        "op8_decontamination": decontam.op8_decontamination,
        "op9_secret_scans": secretscan.op9_secret_scans,
        "op10_near_duplicates": neardup.op10_near_duplicates,
    }


def oracle_sql() -> dict[str, str]:
    """The other methods (regex positions, checksums, tokenizers, trained models, similarity components) are tested against
    brute force instead."""
    return {"op4_quality_rules": oracles.quality_rules()}
