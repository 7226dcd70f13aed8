"""The queries of this subpackage, and the SQL that checks them."""

from __future__ import annotations

from ledgerlens.llm import bpe, chat_format, conversation_repair, embedding_dedup, html_extract, license_scan, lm_score, mixing, near_dedup, phrases, quality_classifier, quality_rules, url_filters

QUERIES = {
    f.__name__: f
    for f in (
        embedding_dedup.op1_embedding_dedup,
        lm_score.op2_lm_score,
        chat_format.op3_chat_format,
        mixing.op4_mixing,
        bpe.op5_bpe,
        quality_classifier.op6_quality_classifier,
        near_dedup.op7_near_dedup,
        url_filters.op8_url_filters,
        quality_rules.op9_quality_rules,
        license_scan.op10_license_scan,
        html_extract.op11_html_extract,
        phrases.op12_phrases,
        conversation_repair.op13_conversation_repair,
    )
}
ORACLES = {
    "op1_embedding_dedup": embedding_dedup.OP1_SQL,
    "op3_chat_format": chat_format.OP3_SQL,
    "op4_mixing": mixing.OP4_SQL,
    "op7_near_dedup": near_dedup.OP7_SQL,
    "op8_url_filters": url_filters.OP8_SQL,
    "op9_quality_rules": quality_rules.OP9_SQL,
    "op11_html_extract": html_extract.OP11_SQL,
    "op12_phrases": phrases.OP12_SQL,
    "op13_conversation_repair": conversation_repair.OP13_SQL,
}
