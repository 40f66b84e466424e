"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontamination, html_extraction, jaccard_join, language_id, quality_rules, sentencepiece_codec, sharding, token_files, url_filters, warc

QUERIES = {
    "op1_sentencepiece": sentencepiece_codec.op1_sentencepiece,
    "op2_url_filters": url_filters.op2_url_filters,
    "op3_sharding": sharding.op3_sharding,
    "op4_decontamination": decontamination.op4_decontamination,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op6_token_files": token_files.op6_token_files,
    "op7_warc": warc.op7_warc,
    "op8_language_id": language_id.op8_language_id,
    "op9_html_extraction": html_extraction.op9_html_extraction,
    "op10_quality_rules": quality_rules.op10_quality_rules,
}
SQL = {
    "op2_url_filters": url_filters.OP2_SQL,
    "op3_sharding": sharding.OP3_SQL,
    "op4_decontamination": decontamination.OP4_SQL,
    "op5_jaccard_join": jaccard_join.OP5_SQL,
    "op7_warc": warc.OP7_SQL,
}
