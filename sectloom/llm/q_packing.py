"""p8: documents in containers of 4,096 tokens."""

from __future__ import annotations

from sectloom.llm.base import LLM
from sectloom.llm.packing import pack
from sectloom.plans.runtime import table


@LLM("p8_found")
def p8_found(spark, d):
    """Documents that were split because they exceed a container by themselves."""
    p = pack(table(spark, d, "documents"), "doc_id", "text")
    return p.filter("n_pieces > 1 and piece_no = 0").select("doc_id").distinct()


@LLM("p8_containers")
def p8_containers(spark, d):
    """The container of every document or piece of one."""
    return pack(table(spark, d, "documents"), "doc_id", "text")
