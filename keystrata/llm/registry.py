"""The operators' queries and SQL, for the entry module."""

from __future__ import annotations

from keystrata.llm import audio, chat, html, mixing, packing, quality, repeats, simhash, urls, weighted


def queries() -> dict:
    return {
        "op1_best_fit_packing": packing.op1_best_fit_packing,
        "op2_mix_sources": mixing.op2_mix_sources,
        "op3_simhash_near_dedup": simhash.op3_simhash_near_dedup,
        "op4_document_fingerprints": weighted.op4_document_fingerprints,
        "op5_html_extraction": html.op5_html_extraction,
        "op6_media_fingerprints": audio.op6_media_fingerprints,
        "op7_quality_classifier": quality.op7_quality_classifier,
        "op8_url_filters": urls.op8_url_filters,
        "op9_chat_formatting": chat.op9_chat_formatting,
        "op10_suffix_array_dedup": repeats.op10_suffix_array_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_mix_sources": mixing.OP2_SQL, "op8_url_filters": urls.OP8_SQL, "op9_chat_formatting": chat.OP9_SQL, "op10_suffix_array_dedup": repeats.OP10_SQL}
