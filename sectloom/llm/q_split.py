"""p3: oversized chunks."""

from __future__ import annotations

from sectloom.llm.base import LLM
from sectloom.llm.splitting import oversized_boundaries, split_oversized
from sectloom.plans.runtime import table


@LLM("p3_found")
def p3_found(spark, d):
    """Oversized chunks and the kindest boundary that suffices for them."""
    return oversized_boundaries(table(spark, d, "lex_chunk_meta"), "record_id", "text").select("record_id", "boundary")


@LLM("p3_pieces")
def p3_pieces(spark, d):
    """The pieces of all oversized chunks, numbered within doc_id, section_idx and chunk_idx."""
    carry = ["doc_id", "section_idx", "chunk_idx", "section_title"]
    return split_oversized(table(spark, d, "lex_chunk_meta"), "record_id", "text", carry)
