"""Registered queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from postwatch.llm import (
    audit,
    bpe,
    chat,
    exact,
    langid,
    licenses,
    lines,
    packing,
    quality,
    simhash,
    substring,
    warc,
    whitening,
)

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_packing": packing.op2_packing,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_line_dedup": lines.op4_line_dedup,
    "op5_language_id": langid.op5_language_id,
    "op6_chat_format": chat.op6_chat_format,
    "op7_simhash_neardup": simhash.op7_simhash_neardup,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_exact_dedup": exact.op9_exact_dedup,
    "op10_bpe": bpe.op10_bpe,
    "op11_filter_audit": audit.op11_filter_audit,
    "op12_substring_dedup": substring.op12_substring_dedup,
    "op13_whitening": whitening.op13_whitening,
}

ORACLES = {
    "op1_warc": warc.OP1_SQL,
    "op6_chat_format": chat.OP6_SQL,
    "op9_exact_dedup": exact.OP9_SQL,
    "op11_filter_audit": audit.OP11_SQL,
    "op12_substring_dedup": substring.OP12_SQL,
}
