"""p10: texts decoded with the wrong encoding."""

from __future__ import annotations

from sectloom.llm.base import LLM
from sectloom.llm.encoding import garbled
from sectloom.plans.runtime import table


@LLM("p10_found")
def p10_found(spark, d):
    """Documents with a garbled passage."""
    return garbled(table(spark, d, "documents"), "doc_id", "text").select("doc_id").distinct()


@LLM("p10_restored")
def p10_restored(spark, d):
    """Their texts with the original characters where these can be known."""
    return garbled(table(spark, d, "documents"), "doc_id", "text")
