"""Queries of the training-data operators, added to __spark_entry__.py when this subpackage is present."""

from __future__ import annotations

from importlib import import_module

#: operator module, query, name of its SQL in the module or None
REGISTERED = [
    ("imatch", "op5_imatch", None),
    ("packing", "op7_packing", None),
    ("chat", "op2_chat_tree", None),
    ("substring_dedup", "op4_substring_dedup", None),
    ("rule_quality", "op8_rule_quality", None),
    ("line_chunks", "op10_line_chunks", None),
    ("byte_bpe", "op3_byte_bpe", None),
    ("language_id", "op9_language_id", None),
    ("simhash", "op1_simhash", None),
    ("exact_dedup", "op6_exact_dedup", "OP6_SQL"),
    ("hard_negatives", "op11_hard_negatives", "OP11_SQL"),
    ("fill_in_middle", "op12_fill_in_middle", "OP12_SQL"),
    ("token_counts", "op13_token_counts", None),
]


def queries() -> dict:
    return {name: getattr(import_module(f"boutlens.llm.{module}"), name) for module, name, _ in REGISTERED}


def oracle_sql() -> dict:
    return {name: getattr(import_module(f"boutlens.llm.{module}"), sql) for module, name, sql in REGISTERED if sql}
