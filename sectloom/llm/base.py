"""Registry of this subpackage's queries."""

from __future__ import annotations

from sectloom.plans.registry import Registry

LLM = Registry()
