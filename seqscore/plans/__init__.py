
from __future__ import annotations

import importlib

_MODULES = ["q_relational", "q_metrics", "q_stats", "q_distance", "q_similarity", "q_motifs", "q_models", "q_more", "q_sources"]


def all_queries():
    """(queries, oracle_sql) after importing every query module."""
    for m in _MODULES:
        importlib.import_module(f"seqscore.plans.{m}")
    from seqscore.plans.registry import ORACLE, QUERIES
    return QUERIES, ORACLE
