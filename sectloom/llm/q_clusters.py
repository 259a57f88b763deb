"""p2: clusters of similar sections, and the right community of sections that lack it."""

from __future__ import annotations

from pyspark.sql import functions as F

from sectloom.llm.base import LLM
from sectloom.llm.gridclust import cluster_majority, describe, grid_clusters
from sectloom.plans.runtime import cut, table

DIM = 256


def _members(spark, d):
    return cut(grid_clusters(table(spark, d, "sect_embedding"), "record_id", "emb", DIM), "members")


@LLM("p2_found")
def p2_found(spark, d):
    """Sections that clearly belong to a cluster but carry another community, with the right one."""
    m, nodes = _members(spark, d), table(spark, d, "sect_node").select("record_id", "community")
    right = cluster_majority(m, nodes, "record_id", "community").select("cluster", F.col("community").alias("right"))
    j = m.filter("clear").join(nodes, "record_id").join(F.broadcast(right), "cluster")  # right: a row a cluster, at most axes / DENSE_SHARE
    wrong = F.col("community").isNull() | (F.col("community") != F.col("right"))
    return j.filter(wrong).select("record_id", F.col("right").cast("int").alias("community"))


@LLM("p2_clusters")
def p2_clusters(spark, d):
    """Size, community and typical members of each cluster."""
    m, nodes = _members(spark, d), table(spark, d, "sect_node").select("record_id", "community")
    right = cluster_majority(m, nodes, "record_id", "community").select("cluster", "community")
    return describe(m, "record_id").join(right, "cluster", "left").select("cluster", "community", "size", "densest_cell", "typical")


@LLM("p2_members")
def p2_members(spark, d):
    """The cluster of every section with a usable vector; null if it is near none."""
    return _members(spark, d).select("record_id", "cluster", "clear")
