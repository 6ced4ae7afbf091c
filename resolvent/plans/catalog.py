"""All queries of the engine by name, and the same results as DuckDB SQL."""

from __future__ import annotations

from . import extra_queries, key_oracles, match_queries, more_queries, relational_queries, source_queries, text_queries

_ALL = (match_queries, text_queries, relational_queries, source_queries, more_queries, extra_queries)
QUERIES: dict = {k: v for m in _ALL for k, v in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for m in _ALL for k, v in m.ORACLES.items()} | key_oracles.ORACLES
