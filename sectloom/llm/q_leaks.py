"""p9: test passages inside documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from sectloom.llm.base import LLM
from sectloom.llm.leakage import find_leaks
from sectloom.plans.runtime import table


def _leaks(spark, d):
    return find_leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_item"), "item_id", "text")


@LLM("p9_found")
def p9_found(spark, d):
    """Documents that hold a test item in large part."""
    return _leaks(spark, d).select("doc_id", "item_id")


@LLM("p9_leak_report")
def p9_leak_report(spark, d):
    """Per test item: documents that hold it, and the largest share of its words in one of them."""
    j = _leaks(spark, d).join(table(spark, d, "eval_item").select("item_id", "suite", "split"), "item_id")
    return j.groupBy("item_id", "suite", "split").agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.max(F.col("run_words") / F.col("item_words")), 4).alias("max_share"))
