"""Queries of the training-data operators and the SQL that DuckDB can hold them against."""

from __future__ import annotations

from tidemark.llm import decontaminate, html_extract, language_model, license_scan, line_dedup, near_dedup, piece_codec, quality_rules, secret_scan, url_filter

QUERIES: dict = {
    "op1_quality_rules": quality_rules.query,
    "op2_language_model": language_model.query,
    "op3_line_dedup": line_dedup.query,
    "op4_near_dedup": near_dedup.query,
    "op5_secret_scan": secret_scan.query,
    "op6_decontaminate": decontaminate.query,
    "op7_license_scan": license_scan.query,
    "op8_piece_codec": piece_codec.query,
    "op9_url_filter": url_filter.query,
    "op10_html_extract": html_extract.query,
}
ORACLE_SQL: dict[str, str] = {
    "op3_line_dedup": line_dedup.ORACLE_SQL,
    "op5_secret_scan": secret_scan.ORACLE_SQL,
    "op6_decontaminate": decontaminate.ORACLE_SQL,
    "op7_license_scan": license_scan.ORACLE_SQL,
    "op9_url_filter": url_filter.ORACLE_SQL,
}
