"""All core queries and their SQL twins, by name."""

from __future__ import annotations

from recollect.plans import core_problems, graph_queries, memory_queries, recall_queries, registry_queries, source_queries

MODULES = [core_problems, memory_queries, recall_queries, graph_queries, registry_queries, source_queries]
FLAGSHIP = recall_queries.e_hybrid


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
