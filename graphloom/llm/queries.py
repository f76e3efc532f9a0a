"""The queries of this package, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html_text, jaccard, mixing, pseudonyms, quality, repeats, token_frames, toxicity, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_repeats": repeats.op1_suffix_repeats,
        "op2_jaccard_join": jaccard.op2_jaccard_join,
        "op3_html_text": html_text.op3_html_text,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_pseudonyms": pseudonyms.op5_pseudonyms,
        "op6_url_filter": url_filter.op6_url_filter,
        "op7_token_frames": token_frames.op7_token_frames,
        "op8_decontaminate": decontaminate.op8_decontaminate,
        "op9_quality_rules": quality.op9_quality_rules,
        "op10_mix_sources": mixing.op10_mix_sources,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_repeats": repeats.ORACLE, "op2_jaccard_join": jaccard.ORACLE, "op8_decontaminate": decontaminate.ORACLE}
