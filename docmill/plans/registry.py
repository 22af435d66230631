"""All queries of the core package and the SQL they are checked against."""

from __future__ import annotations

from docmill.plans import agent_queries, entity_queries, graph_queries, retrieval_queries, search_queries, service_queries, state_queries, text_queries

MODULES = (retrieval_queries, text_queries, entity_queries, graph_queries, agent_queries, service_queries, state_queries, search_queries)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
