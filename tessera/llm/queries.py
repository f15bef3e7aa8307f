"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import bytebpe, conversations, jaccard, langid, licenses, lines, middles, mixing, neighbours, pieces, quality, suffixes, urls

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_language_id": langid.op2_language_id,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_line_dedup": lines.op4_line_dedup,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_nearest": neighbours.op6_nearest,
    "op7_suffix_dedup": suffixes.op7_suffix_dedup,
    "op8_ngram_jaccard": jaccard.op8_ngram_jaccard,
    "op9_url_filter": urls.op9_url_filter,
    "op10_sentencepiece": pieces.op10_sentencepiece,
    "op11_fill_in_middle": middles.op11_fill_in_middle,
    "op12_conversation_repair": conversations.op12_conversation_repair,
    "op13_byte_bpe": bytebpe.op13_byte_bpe,
}
ORACLES = {
    "op1_mix_sources": mixing.ORACLE,
    "op3_license_scan": licenses.ORACLE,
    "op8_ngram_jaccard": jaccard.ORACLE,
    "op9_url_filter": urls.ORACLE,
    "op11_fill_in_middle": middles.ORACLE,
}
