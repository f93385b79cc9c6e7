"""The queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

import importlib

# Module and query of each operator, in the order of their numbers.
NAMES = {
    "toxicity": "op1_toxicity",
    "class_lm": "op2_class_lm",
    "url_rules": "op3_url_rules",
    "ann": "op6_ann_top20",
    "pivots": "op9_exact_top5",
    "bpe": "op4_bpe_round_trip",
    "mixing": "op5_mix_sources",
    "near_dedup": "op7_near_dedup",
    "passages": "op8_substring_dedup",
    "chat": "op10_chat_windows",
    "merkle": "op11_merkle",
    "filter_audit": "op12_filter_audit",
    "set_join": "op13_set_join",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"lectern.llm.{module}"), name) for module, name in NAMES.items()}


def oracles() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"lectern.llm.{module}"), "ORACLE_SQL", None) for module, name in NAMES.items()}
    return {name: sql for name, sql in found.items() if sql}
