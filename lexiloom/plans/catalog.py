"""Registered queries and the SQL that each is held against."""

from __future__ import annotations

from lexiloom.plans import corpus_queries, fixture_queries, prose_queries, word_queries

MODULES = (corpus_queries, prose_queries, word_queries, fixture_queries)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
