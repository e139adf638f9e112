"""The operators' queries by name, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import chat, decontaminate, language, mixing, ngram_join, quality, substrings, suffixes, topk, url_rules

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_substrings": substrings.op2_substrings,
    "op3_url_rules": url_rules.op3_url_rules,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_chat": chat.op5_chat,
    "op6_ngram_join": ngram_join.op6_ngram_join,
    "op7_topk": topk.op7_topk,
    "op8_language": language.op8_language,
    "op9_mixing": mixing.op9_mixing,
    "op10_suffixes": suffixes.op10_suffixes,
}

ORACLES = {
    "op4_decontaminate": decontaminate.OP4_SQL,
    "op5_chat": chat.OP5_SQL,
    "op6_ngram_join": ngram_join.OP6_SQL,
    "op7_topk": topk.OP7_SQL,
}
