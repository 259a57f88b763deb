"""p7: noise of scanned pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from sectloom.llm.base import LLM
from sectloom.llm.scans import repair_scans
from sectloom.plans.runtime import table


def _repaired(spark, d):
    return repair_scans([(t, table(spark, d, t)) for t in ("sect_node", "lex_chunk_meta")], "record_id", "text")


@LLM("p7_found")
def p7_found(spark, d):
    """One row for each kind of noise a text holds."""
    kinds = F.array(*[F.when(F.col(c) > 0, F.lit(c)) for c in ("hyphen", "glyph", "header", "page_no")])
    return _repaired(spark, d).select("source_table", "record_id", F.explode(F.array_compact(kinds)).alias("noise")).distinct()


@LLM("p7_repaired")
def p7_repaired(spark, d):
    """Texts with their noise repaired, and the number of repairs of each kind."""
    return _repaired(spark, d)
