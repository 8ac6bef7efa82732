"""Registered queries of this subpackage: one opN_<name> for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

#: query name: module of its operator
MODULES = {
    "op1_ann": "ann",
    "op2_mixing": "mixing",
    "op3_segment_topk": "segment_topk",
    "op4_language": "language",
    "op5_secrets": "secrets",
    "op6_neardup": "neardup",
    "op7_packing": "packing",
    "op8_main_text": "html_text",
    "op9_token_files": "token_files",
    "op10_sharding": "sharding",
    "op11_simhash": "simhash",
    "op12_vector_codes": "vector_codes",
    "op13_whitening": "whitening",
}


def _runner(module: str):
    return lambda spark, sf_dir: import_module(f"{__package__}.{module}").query(spark, sf_dir)


def queries() -> dict:
    return {name: _runner(module) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "ORACLE", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
