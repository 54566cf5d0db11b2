"""Operators for preparing training data. Nothing outside this folder imports it but the entry file."""

from importlib import import_module

#: Query name by module; each module has the query under this name and its ORACLE_SQL (or None).
MODULES = {
    "packing": "op1_packing",
    "exact_dedup": "op2_exact_dedup",
    "mixing": "op3_mixing",
    "quality_qda": "op4_quality_classifier",
    "quality_rules": "op5_quality_rules",
    "license_scan": "op6_license_scan",
    "html_extract": "op7_html_extraction",
    "suffix_dedup": "op8_suffix_dedup",
    "unit_dedup": "op9_substring_dedup",
    "near_dedup": "op10_near_dedup",
    "token_align": "op11_token_alignment",
    "url_filter": "op12_url_filter",
    "divergence": "op13_source_divergence",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__name__}.{module}"), name) for module, name in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: import_module(f"{__name__}.{module}").ORACLE_SQL for module, name in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
