"""p1: the most similar sections of every section."""

from __future__ import annotations

from pyspark.sql import functions as F

from sectloom.llm.base import LLM
from sectloom.llm.knn import LEAF, TREES, encode, exact_cosine, expand, greedy_search, nearest, nn_descent
from sectloom.plans.runtime import cut, table

DIM, K, MIN_COS = 256, 5, 0.75
#: Error of a similarity of packed vectors, allowed for before the exact check.
SLACK = 0.01


@LLM("p1_found")
def p1_found(spark, d):
    """Pairs of sections where one is among the other's five most similar and their cosine is at least 0.75."""
    emb = table(spark, d, "sect_embedding")
    near = nearest(emb, "record_id", "emb", DIM, K).filter(F.col("s") >= MIN_COS - SLACK)
    pairs = cut(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near")
    hit = exact_cosine(pairs, emb, "record_id", "emb", DIM).filter(F.col("cos") >= MIN_COS)
    return hit.select(F.col("a").alias("record_a"), F.col("b").alias("record_b"))


@LLM("p1_neighbours")
def p1_neighbours(spark, d):
    """The five most similar sections of every section."""
    n = nearest(table(spark, d, "sect_embedding"), "record_id", "emb", DIM, K)
    return n.select(F.col("a").alias("record_id"), F.col("b").alias("neighbour"), F.round(F.col("s").cast("double"), 3).alias("cosine"))


@LLM("p1_search")
def p1_search(spark, d):
    """The five most similar sections of every section whose id is divisible by 100, by greedy search in the graph of all."""
    reps, members = encode(table(spark, d, "sect_embedding"), "record_id", "emb", DIM, TREES, LEAF)
    graph = nn_descent(reps, DIM)
    asked = reps.select("id") if members is None else reps.select("id").unionByName(members.select("id"))
    asked = asked.filter(F.col("id") % 100 == 0).distinct()
    if members is not None:  # a copy is searched for by its representative
        asked = asked.join(members, "id", "left").select(F.coalesce("rep", "id").alias("id")).distinct()
    q = reps.join(asked, "id", "left_semi").select(F.col("id").alias("q"), "code", "scale", "leaves")
    found = greedy_search(graph, reps, q, DIM, K + 1)
    out = expand(found.select(F.col("q").alias("a"), "b", "s"), members, K).filter(F.col("a") % 100 == 0)
    return out.select(F.col("a").alias("record_id"), F.col("b").alias("neighbour"), F.round(F.col("s").cast("double"), 3).alias("cosine"))
