"""Registered queries of the engine and the SQL each is checked against."""

from __future__ import annotations

from gleaner.queries import analytics, content, postings, profiles, ranking, reviews, surfaces

MODULES = (analytics, postings, content, surfaces, profiles, ranking, reviews)

QUERIES = {name: f for module in MODULES for name, f in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
