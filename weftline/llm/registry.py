"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import (
    binary_output, chat_format, decontamination, html_extraction, jaccard_join, license_scan, line_dedup, packing, prefix_bpe, quality_rules,
    substring_dedup, token_alignment, word_runs,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": license_scan.op1_license_scan,
        "op2_chat_format": chat_format.op2_chat_format,
        "op3_best_fit_packing": packing.op3_best_fit_packing,
        "op4_substring_dedup": substring_dedup.op4_substring_dedup,
        "op5_binary_output": binary_output.op5_binary_output,
        "op6_jaccard_join": jaccard_join.op6_jaccard_join,
        "op7_line_dedup": line_dedup.op7_line_dedup,
        "op8_quality_rules": quality_rules.op8_quality_rules,
        "op9_decontamination": decontamination.op9_decontamination,
        "op10_html_extraction": html_extraction.op10_html_extraction,
        "op11_periodic_runs": word_runs.op11_periodic_runs,
        "op12_token_alignment": token_alignment.op12_token_alignment,
        "op13_bpe_codec": prefix_bpe.op13_bpe_codec,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": chat_format.ORACLE, "op9_decontamination": decontamination.ORACLE}
