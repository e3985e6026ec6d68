"""The queries of this package and their SQL, by name."""

from __future__ import annotations

from treemill.llm import bpe, byte_bpe, exact_dedup, fill_in_middle, language_id, licenses, mixing, quality_rules, resampling, secrets, simhash, spelling, substring_dedup

QUERIES = {
    "op1_quality_classifier": resampling.op1,
    "op2_source_mixing": mixing.op2,
    "op3_license_scan": licenses.op3,
    "op4_substring_dedup": substring_dedup.op4,
    "op5_language_id": language_id.op5,
    "op6_quality_rules": quality_rules.op6,
    "op7_bpe": bpe.op7,
    "op8_exact_dedup": exact_dedup.op8,
    "op9_secret_scan": secrets.op9,
    "op10_simhash": simhash.op10,
    "op11_spelling_variants": spelling.op11,
    "op12_fill_in_middle": fill_in_middle.op12,
    "op13_byte_bpe": byte_bpe.op13,
}

ORACLE_SQL = {"op8_exact_dedup": exact_dedup.OP8_SQL, "op12_fill_in_middle": fill_in_middle.OP12_SQL}
