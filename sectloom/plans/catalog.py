"""Imports every module that registers queries."""

from __future__ import annotations

from sectloom.plans import q_dense, q_entities, q_graph, q_lexical, q_life, q_more, q_search, q_stats, q_text  # noqa: F401
from sectloom.plans.registry import CORE

FLAGSHIP = "l04_bm25_search"

__all__ = ["CORE", "FLAGSHIP"]
