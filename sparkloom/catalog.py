
from __future__ import annotations

from . import agent_queries, graph_queries, inventory_queries, recorded_queries, retrieval_queries, scan_queries, selection_queries, synthetic_queries, telemetry_queries, text_queries

_PARTS = (graph_queries, text_queries, retrieval_queries, telemetry_queries, agent_queries, inventory_queries, selection_queries, scan_queries, synthetic_queries, recorded_queries)
QUERIES: dict = {k: f for p in _PARTS for k, f in p.QUERIES.items()}
SQL: dict = {k: s for p in _PARTS for k, s in p.SQL.items()}


def flagship(spark, sf_dir: str):
    return QUERIES["q120_hybrid_search"](spark, sf_dir)
