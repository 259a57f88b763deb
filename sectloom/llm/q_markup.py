"""p5: markup in sections."""

from __future__ import annotations

from sectloom.llm.base import LLM
from sectloom.llm.markup import clean_markup
from sectloom.plans.runtime import table


@LLM("p5_found")
def p5_found(spark, d):
    """Section texts and titles that hold markup."""
    return clean_markup(table(spark, d, "sect_node"), "record_id", ["text", "section_title"], "doc_id").select("record_id", "field").distinct()


@LLM("p5_clean")
def p5_clean(spark, d):
    """Their clean text, with the number of pieces of each kind."""
    return clean_markup(table(spark, d, "sect_node"), "record_id", ["text", "section_title"], "doc_id")
