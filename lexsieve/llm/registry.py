"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from lexsieve.llm import (
    bpe_codec,
    chat_format,
    context_tree,
    ngram_join,
    packing,
    phrase_fingerprint,
    pu_classifier,
    quality_rules,
    secret_scan,
    url_rules,
)

QUERIES = {
    "op1_pu_classifier": pu_classifier.op1_pu_classifier,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_secret_scan": secret_scan.op3_secret_scan,
    "op4_phrase_fingerprint": phrase_fingerprint.op4_phrase_fingerprint,
    "op5_context_tree": context_tree.op5_context_tree,
    "op6_chat_format": chat_format.op6_chat_format,
    "op7_ngram_join": ngram_join.op7_ngram_join,
    "op8_packing": packing.op8_packing,
    "op9_bpe_codec": bpe_codec.op9_bpe_codec,
    "op10_url_rules": url_rules.op10_url_rules,
}

ORACLE_SQL = {
    "op2_quality_rules": quality_rules.OP2_SQL,
    "op6_chat_format": chat_format.OP6_SQL,
    "op7_ngram_join": ngram_join.OP7_SQL,
}
