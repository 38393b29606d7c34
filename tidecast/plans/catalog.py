"""All queries of the forecast operators, with their SQL oracles."""

from __future__ import annotations

from . import engine_queries, forecast_queries, inference_queries, panel_queries, reading_queries, score_queries, study_queries, text_queries

BOOKS = [panel_queries.book, score_queries.book, inference_queries.book, forecast_queries.book, engine_queries.book, text_queries.book, reading_queries.book, study_queries.book]
QUERIES: dict = {}
SQL: dict = {}
for b in BOOKS:
    QUERIES |= b.queries
    SQL |= b.sql
FLAGSHIP = "a17_a41_composite"
