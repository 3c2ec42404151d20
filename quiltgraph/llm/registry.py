"""Queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from . import chat, decontaminate, licenses, lm, mixing, quality, simhash, suffixdedup, urlfilter, warc

QUERIES = {
    "op1_warc_transactions": warc.op1_warc_transactions,
    "op10_suffix_array_dedup": suffixdedup.op10_suffix_array_dedup,
    "op2_chat_formatting": chat.op2_chat_formatting,
    "op3_mix_sources": mixing.op3_mix_sources,
    "op4_simhash_near_dedup": simhash.op4_simhash_near_dedup,
    "op7_lm_scoring": lm.op7_lm_scoring,
    "op8_license_scans": licenses.op8_license_scans,
    "op9_quality_rules": quality.op9_quality_rules,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_url_filters": urlfilter.op6_url_filters,
}
ORACLE_SQL = {
    "op2_chat_formatting": chat.SQL,
    "op3_mix_sources": mixing.SQL,
    "op5_decontamination": decontaminate.SQL,
    "op6_url_filters": urlfilter.SQL,
    "op9_quality_rules": quality.SQL,
}
