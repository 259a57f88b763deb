"""Tables of the test data in the shape operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectloom.operators import lexical
from sectloom.plans.runtime import cut, table


def sections(spark, d) -> DataFrame:
    return table(spark, d, "sect_node")


def post(spark, d) -> DataFrame:
    """Postings of the sections, written once per query: the index that later stages share."""
    return cut(lexical.postings(sections(spark, d), "record_id", "text"), "post")


def mentions(spark, d) -> DataFrame:
    """(build_id, ord, entity_id, cnt): mentions that took place, once each."""
    b = table(spark, d, "sect_build").select("build_id", F.get_json_object("params", "$.run_id").alias("run_id"))
    m = table(spark, d, "mentions").filter("cnt > 0").join(b, "run_id")
    return m.groupBy("build_id", "ord", "entity_id").agg(F.max("cnt").cast("long").alias("cnt"))


def edges(spark, d) -> DataFrame:
    """(build_id, a, b, s): stored co-mention edges with positive npmi, canonical, once each."""
    e = table(spark, d, "sect_entity_edge").filter("kind = 'co_mention' AND npmi > 0 AND a <> b")
    return e.groupBy("build_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("npmi").cast("double").alias("s"))


def symmetric(e: DataFrame) -> DataFrame:
    """Edges in both directions."""
    return e.select("build_id", "a", "b", "s").unionByName(e.select("build_id", F.col("b").alias("a"), F.col("a").alias("b"), "s"))
