"""Driver queries: one per operator, each with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from . import analysis_queries, audit_queries, callset_queries, format_queries, locus_queries, review_queries

_ALL: dict = {**callset_queries.QUERIES, **locus_queries.QUERIES, **analysis_queries.QUERIES, **review_queries.QUERIES, **audit_queries.QUERIES, **format_queries.QUERIES}
QUERIES = {name: q for name, (q, _) in _ALL.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in _ALL.items() if sql}
