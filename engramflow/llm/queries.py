"""The opN_ queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import chat_format, decontaminate, dominance, gru_lm, html_text, one_bit_search, periodic_runs, pii, quality_rules, sentencepiece, simhash, substring_dedup, suffix_dedup

_MODULES = {
    "op1_gru_lm": gru_lm,
    "op2_suffix_dedup": suffix_dedup,
    "op3_sentencepiece": sentencepiece,
    "op4_decontaminate": decontaminate,
    "op5_pii": pii,
    "op6_substring_dedup": substring_dedup,
    "op7_chat_format": chat_format,
    "op8_simhash": simhash,
    "op9_html_text": html_text,
    "op10_quality_rules": quality_rules,
    "op11_dominance": dominance,
    "op12_one_bit_search": one_bit_search,
    "op13_periodic_runs": periodic_runs,
}


def queries() -> dict:
    return {name: module.query for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.oracle() for name, module in _MODULES.items() if hasattr(module, "oracle")}
