"""Queries of the library by name, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from .plans import document_queries, driver_queries, source_queries, stream_queries, trial_queries

QUERIES = {**driver_queries.QUERIES, **document_queries.QUERIES, **trial_queries.QUERIES, **stream_queries.QUERIES, **source_queries.QUERIES}
SQL = {**driver_queries.SQL, **document_queries.SQL, **trial_queries.SQL, **stream_queries.SQL, **source_queries.SQL}
