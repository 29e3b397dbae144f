"""Registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, conversation_repair, decontamination, exact_dedup, html_extract, importance, language_id, license_scan, ngram_join, quality, source_mix, substring_dedup, token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mix": source_mix.op1_source_mix,
    "op2_html_extract": html_extract.op2_html_extract,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op4_quality": quality.op4_quality,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_language_id": language_id.op8_language_id,
    "op9_license_scan": license_scan.op9_license_scan,
    "op10_decontamination": decontamination.op10_decontamination,
    "op11_importance": importance.op11_importance,
    "op12_chat_format": chat_format.op12_chat_format,
    "op13_conversation_repair": conversation_repair.op13_conversation_repair,
}
ORACLES: dict[str, str] = {
    "op3_ngram_join": ngram_join.ORACLE,
    "op6_substring_dedup": substring_dedup.ORACLE,
    "op7_exact_dedup": exact_dedup.ORACLE,
    "op10_decontamination": decontamination.ORACLE,
    "op11_importance": importance.ORACLE,
    "op12_chat_format": chat_format.ORACLE,
    "op13_conversation_repair": conversation_repair.ORACLE,
}
