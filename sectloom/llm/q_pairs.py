"""p4: entity pairs named together."""

from __future__ import annotations

from pyspark.sql import functions as F

from sectloom.llm.base import LLM
from sectloom.llm.cooccur import associations, check_stored_edges
from sectloom.plans.runtime import table

MIN_SHARED, MIN_NPMI = 5, 0.5

_PAIRS = """
WITH m AS (SELECT DISTINCT run_id, ord, entity_id FROM mentions WHERE cnt > 0 AND run_id IS NOT NULL AND ord IS NOT NULL AND entity_id IS NOT NULL),
n AS (SELECT run_id, count(DISTINCT ord) AS n FROM m GROUP BY run_id),
f AS (SELECT run_id, entity_id, count(*) AS c FROM m GROUP BY run_id, entity_id),
p AS (SELECT x.run_id, x.entity_id AS a, y.entity_id AS b, count(*) AS n_shared FROM m x JOIN m y ON x.run_id = y.run_id AND x.ord = y.ord AND x.entity_id < y.entity_id
      GROUP BY ALL HAVING count(*) >= 5),
s AS (SELECT p.*, fa.c AS n_a, fb.c AS n_b, n.n, CASE WHEN n_shared >= n.n THEN 0.0 ELSE
  ln((n_shared / n.n) / ((fa.c / n.n) * (fb.c / n.n))) / -ln(n_shared / n.n) END AS npmi
  FROM p JOIN f fa ON fa.run_id = p.run_id AND fa.entity_id = p.a JOIN f fb ON fb.run_id = p.run_id AND fb.entity_id = p.b JOIN n ON n.run_id = p.run_id)
"""


def _pairs(spark, d):
    return associations(table(spark, d, "mentions"), "run_id", "ord", "entity_id", "cnt", min_shared=MIN_SHARED)


@LLM("p4_found", sql=_PAIRS + "SELECT run_id, a, b FROM s WHERE npmi >= 0.5")
def p4_found(spark, d):
    """Pairs in at least 5 sections of a run with npmi of at least 0.5."""
    return _pairs(spark, d).filter(F.col("npmi") >= MIN_NPMI).select("run_id", "a", "b")


@LLM("p4_pairs", sql=_PAIRS + "SELECT run_id, a, b, n_shared, round(npmi, 6) AS npmi, round(n_shared * n / (n_a * n_b), 6) AS lift FROM s")
def p4_pairs(spark, d):
    """All pairs in at least 5 sections of a run, with count, npmi and lift."""
    return _pairs(spark, d).select("run_id", "a", "b", "n_shared", F.round("npmi", 6).alias("npmi"), F.round("lift", 6).alias("lift"))


@LLM("p4_edge_check")
def p4_edge_check(spark, d):
    """State of each stored co_mention edge against the rebuilt pairs with positive npmi."""
    builds = table(spark, d, "sect_build").select("build_id", F.get_json_object("params", "$.run_id").alias("run_id"))
    return check_stored_edges(table(spark, d, "sect_entity_edge"), _pairs(spark, d).filter(F.col("npmi") > 0), builds)
