"""Registers the queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

#: Module, function. A module's SQL, where it has one, is the oracle of its query.
_QUERIES = {
    "op1_quality_rules": "quality_rules",
    "op2_nn_descent": "nn_descent",
    "op3_simhash": "simhash",
    "op4_line_crf": "line_crf",
    "op5_token_counts": "token_counts",
    "op6_lm_mixing": "mixing_lm",
    "op7_licenses": "licenses",
    "op8_suffix_dedup": "suffix_dedup",
    "op9_mixing": "mixing",
    "op10_bpe": "bpe",
    "op11_vector_codes": "vector_codes",
    "op12_alignment": "token_alignment",
    "op13_decontamination": "decontamination",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    modules = {name: import_module(f"{__package__}.{module}") for name, module in _QUERIES.items()}
    return {name: m.SQL for name, m in modules.items() if getattr(m, "SQL", None)}
