"""The queries of this subpackage."""

from __future__ import annotations

from quirespark.llm import align_queries, leaks_queries, lookalike_queries, mojibake_queries, pairs_queries, sentences_queries, spans_queries, tokenize_queries

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _module in (lookalike_queries, sentences_queries, pairs_queries, mojibake_queries, align_queries, tokenize_queries, leaks_queries, spans_queries):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
