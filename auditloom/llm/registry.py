"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from auditloom.llm import bpe, decontamination, language_id, lattice_lm, license_scan, line_dedup, quality_rules, simhash_dedup, suffix_dedup, url_filters


def queries() -> dict:
    return {
        "op1_quality_rules": quality_rules.op1_quality_rules,
        "op2_language_id": language_id.op2_language_id,
        "op3_line_dedup": line_dedup.op3_line_dedup,
        "op4_benchmark_decontamination": decontamination.op4_benchmark_decontamination,
        "op5_url_filters": url_filters.op5_url_filters,
        "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
        "op7_simhash_near_dedup": simhash_dedup.op7_simhash_near_dedup,
        "op8_bpe": bpe.op8_bpe,
        "op9_lattice_lm": lattice_lm.op9_lattice_lm,
        "op10_license_scan": license_scan.op10_license_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality_rules.SQL,
        "op3_line_dedup": line_dedup.SQL,
        "op4_benchmark_decontamination": decontamination.SQL,
    }
