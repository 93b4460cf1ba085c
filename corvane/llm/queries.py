"""The registered queries of this subpackage and the SQL that DuckDB can hold them against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, fill_in_middle, html_text, language_id, license_scan, line_dedup, near_dedup, nearest, packing, pieces, secret_scan, token_counts, vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_near_dedup": near_dedup.op3_near_dedup,
    "op4_secret_scan": secret_scan.op4_secret_scan,
    "op5_sentencepiece": pieces.op5_sentencepiece,
    "op6_language_id": language_id.op6_language_id,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_nearest": nearest.op8_nearest,
    "op9_html_text": html_text.op9_html_text,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_fill_in_middle": fill_in_middle.op11_fill_in_middle,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_license_scan": license_scan.op13_license_scan,
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": line_dedup.ORACLE_SQL,
    "op10_exact_dedup": exact_dedup.ORACLE_SQL,
    "op11_fill_in_middle": fill_in_middle.ORACLE_SQL,
    "op12_vector_codes": vector_codes.ORACLE_SQL,
}
