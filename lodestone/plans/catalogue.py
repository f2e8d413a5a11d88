"""Registered queries over the test tables and their SQL twins.

The tables stand in for stored ones: ``embeddings`` for chunks with vectors,
``documents`` for texts, ``orders`` and ``lineitem`` for the catalogue of
documents and chunks, ``conversations`` for questions and answers.
"""

from __future__ import annotations

from lodestone.plans import catalogue_evaluation, catalogue_pipelines, catalogue_search, catalogue_store, catalogue_text

_PARTS = (catalogue_search, catalogue_store, catalogue_text, catalogue_evaluation, catalogue_pipelines)

QUERIES: dict = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
