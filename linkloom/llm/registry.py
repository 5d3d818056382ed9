"""Queries and SQL of the training-data operators, for __spark_entry__.py."""

from __future__ import annotations

from . import byte_bpe, chat_format, decontaminate, html_extract, importance, line_dedup, ngram_join, quality_rules, secret_scan, token_counts

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_importance": importance.op5_importance,
    "op6_secret_scan": secret_scan.op6_secret_scan,
    "op7_chat_format": chat_format.op7_chat_format,
    "op8_byte_bpe": byte_bpe.op8_byte_bpe,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_html_extract": html_extract.op10_html_extract,
}

ORACLE_SQL = {
    "op1_quality_rules": quality_rules.SQL,
    "op7_chat_format": chat_format.SQL,
    "op9_line_dedup": line_dedup.SQL,
}
