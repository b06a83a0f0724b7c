"""Queries and DuckDB SQL of the operators, one per operator."""

from __future__ import annotations

from loomtext.llm import bpe, chat_format, fill_middle, language_id, license_scan, minhash_dedup, quality_rules, source_mixing, suffix_dedup, token_align, token_binary, topk_search, url_filter


def queries() -> dict:
    return {
        "op1_url_filter": url_filter.op1_url_filter,
        "op2_language_id": language_id.op2_language_id,
        "op3_source_mixing": source_mixing.op3_source_mixing,
        "op4_bpe": bpe.op4_bpe,
        "op5_quality_rules": quality_rules.op5_quality_rules,
        "op6_minhash_dedup": minhash_dedup.op6_minhash_dedup,
        "op7_token_binary": token_binary.op7_token_binary,
        "op8_license_scan": license_scan.op8_license_scan,
        "op9_topk_search": topk_search.op9_topk_search,
        "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
        "op11_token_align": token_align.op11_token_align,
        "op12_chat_format": chat_format.op12_chat_format,
        "op13_fill_in_middle": fill_middle.op13_fill_in_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filter": url_filter.oracle_sql(),
        "op3_source_mixing": source_mixing.oracle_sql(),
        "op5_quality_rules": quality_rules.oracle_sql(),
        "op6_minhash_dedup": minhash_dedup.oracle_sql(),
        "op8_license_scan": license_scan.oracle_sql(),
        "op9_topk_search": topk_search.oracle_sql(),
        "op10_suffix_dedup": suffix_dedup.oracle_sql(),
        "op12_chat_format": chat_format.oracle_sql(),
        "op13_fill_in_middle": fill_middle.oracle_sql(),
    }
