"""Queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from listingspark.llm import bpe, conversations, fingerprints, language, licenses, media, negatives, ngram_join, packing, suffix_dedup, topk, toxicity, url_filter


def queries():
    return {
        "op1_media_columns": media.op1_media_columns,
        "op2_url_filter": url_filter.op2_url_filter,
        "op3_ngram_join": ngram_join.op3_ngram_join,
        "op4_packing": packing.op4_packing,
        "op5_fingerprints": fingerprints.op5_fingerprints,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_language": language.op7_language,
        "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
        "op9_license_scan": licenses.op9_license_scan,
        "op10_bpe": bpe.op10_bpe,
        "op11_conversation_repair": conversations.op11_conversation_repair,
        "op12_hard_negatives": negatives.op12_hard_negatives,
        "op13_topk_search": topk.op13_topk_search,
    }


def oracle_sql():
    return {
        "op2_url_filter": url_filter.ORACLE,
        "op3_ngram_join": ngram_join.ORACLE,
        "op9_license_scan": licenses.ORACLE,
        "op11_conversation_repair": conversations.ORACLE,
        "op12_hard_negatives": negatives.ORACLE,
        "op13_topk_search": topk.ORACLE,
    }
