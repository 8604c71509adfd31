"""The queries opN_<name> of this subpackage and their SQL."""

from __future__ import annotations

from lanternfish.llm import decontamination, exact_dedup, html_render, language_id, lm_scoring, mixing, near_dedup, substring_dedup, token_counts, url_filters


def queries() -> dict:
    return {
        "op1_exact_dedup": exact_dedup.query,
        "op2_decontamination": decontamination.query,
        "op3_language_id": language_id.query,
        "op4_html_render": html_render.query,
        "op5_token_counts": token_counts.query,
        "op6_substring_dedup": substring_dedup.query,
        "op7_lm_scoring": lm_scoring.query,
        "op8_near_dedup": near_dedup.query,
        "op9_url_filters": url_filters.query,
        "op10_mixing": mixing.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": exact_dedup.SQL, "op2_decontamination": decontamination.SQL, "op6_substring_dedup": substring_dedup.SQL, "op8_near_dedup": near_dedup.SQL, "op9_url_filters": url_filters.SQL}
