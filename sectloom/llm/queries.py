"""Queries pN_... of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from sectloom.llm import q_clusters, q_encoding, q_knn, q_leaks, q_markup, q_packing, q_pairs, q_scans, q_split, q_terms  # noqa: F401
from sectloom.llm.base import LLM

__all__ = ["LLM"]
