"""Registered queries of this subpackage: name -> (function of (spark, sf_dir), DuckDB SQL or None)."""

from __future__ import annotations

from codelens.llm import (
    chat, decontam, exact_dedup, filter_audit, html_extract, mixing, packing, periodic_runs, quality, sharding, simhash, suffix_dedup, url_filter)

QUERIES = {
    "op1_packing": (packing.op1_packing, None),
    "op2_html_extract": (html_extract.op2_html_extract, None),
    "op3_url_filter": (url_filter.op3_url_filter, url_filter.OP3_SQL),
    "op4_exact_dedup": (exact_dedup.op4_exact_dedup, exact_dedup.OP4_SQL),
    "op5_quality": (quality.op5_quality, None),
    "op6_simhash": (simhash.op6_simhash, None),
    "op7_decontamination": (decontam.op7_decontamination, decontam.OP7_SQL),
    "op8_suffix_dedup": (suffix_dedup.op8_suffix_dedup, suffix_dedup.OP8_SQL),
    "op9_sharding": (sharding.op9_sharding, None),
    "op10_chat": (chat.op10_chat, chat.OP10_SQL),
    "op11_filter_audit": (filter_audit.op11_filter_audit, filter_audit.OP11_SQL),
    "op12_runs": (periodic_runs.op12_runs, None),
    "op13_mixing": (mixing.op13_mixing, None),
}
