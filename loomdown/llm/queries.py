"""The training-data queries and their SQL, by name."""

from __future__ import annotations

import importlib

#: Modules with a query opN_<name>; each may have ORACLE_SQL.
MODULES = {
    "op1_language_id": "language_id",
    "op2_line_dedup": "line_dedup",
    "op3_lm_scoring": "lm_score",
    "op4_token_counts": "token_counts",
    "op5_token_files": "token_files",
    "op6_jaccard_join": "jaccard_join",
    "op7_source_mixing": "mixing",
    "op8_quality_rules": "quality",
    "op9_benchmark_decontamination": "decontaminate",
    "op10_html_extraction": "html_extract",
    "op11_personal_data": "personal_data",
    "op12_lexical_search": "lexical_search",
    "op13_token_alignment": "token_alignment",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f".{module}", __package__), name) for name, module in MODULES.items()}


def oracle_sql() -> dict:
    found = {name: getattr(importlib.import_module(f".{module}", __package__), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
