"""Queries of the corpus operators and the SQL they are held against."""

from __future__ import annotations

import corpus_pipeline
from quillspark.llm import codes, edit_counts, exact_dedup, languages, line_dedup, minhash, mixing, panes, pieces, quality, substring_dedup, token_records, toxicity


def queries():
    return {
        "op1_line_dedup": line_dedup.query,
        "op2_token_records": token_records.query,
        "op3_pieces": pieces.query,
        "op4_exact_dedup": exact_dedup.query,
        "op5_minhash": minhash.query,
        "op6_toxicity": toxicity.query,
        "op7_edit_counts": edit_counts.query,
        "op8_substring_dedup": substring_dedup.query,
        "op9_mixing": mixing.query,
        "op10_quality_rules": quality.query,
        "op11_vector_codes": codes.query,
        "op12_window_panes": panes.query,
        "op13_languages": languages.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql():
    return {"op1_line_dedup": line_dedup.ORACLE, "op4_exact_dedup": exact_dedup.ORACLE, "op5_minhash": minhash.oracle(), "op8_substring_dedup": substring_dedup.ORACLE, "op10_quality_rules": quality.oracle(), "op11_vector_codes": codes.oracle(), "op12_window_panes": panes.ORACLE}
