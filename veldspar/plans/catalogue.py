"""Queries over the given tables, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from . import evaluation_queries, gate_queries, ingest_queries, registry_queries, retrieval_queries, run_queries, structure_queries, text_queries

_PARTS = (registry_queries, ingest_queries, retrieval_queries, text_queries, evaluation_queries, run_queries, structure_queries, gate_queries)
QUERIES: dict = {name: q for part in _PARTS for name, q in part.QUERIES.items()}
ORACLE: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}
