"""Registered queries of this subpackage with their SQL, where SQL can express them."""

from __future__ import annotations

from feedloom.llm import bpe, chat_format, embedding_dedup, fingerprint, hard_negatives, language, line_dedup, ngram_join, quality, secret_scan, source_mix, token_alignment, url_filter
from feedloom.llm.oracles import ORACLES  # noqa: F401

QUERIES = {
    "op1_secret_scan": secret_scan.op1_secret_scan,
    "op2_language": language.op2_language,
    "op3_bpe": bpe.op3_bpe,
    "op4_ngram_join": ngram_join.op4_ngram_join,
    "op5_embedding_dedup": embedding_dedup.op5_embedding_dedup,
    "op6_quality": quality.op6_quality,
    "op7_source_mix": source_mix.op7_source_mix,
    "op8_fingerprint": fingerprint.op8_fingerprint,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_token_alignment": token_alignment.op12_token_alignment,
    "op13_chat_format": chat_format.op13_chat_format,
}
