"""Readers and writers of corpora and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sectloom.functions.text import clean_lines, stem_key, stem_version


def markdown_corpus(spark: SparkSession, root: str, stored: DataFrame | None = None) -> DataFrame:
    """(key, version, path, text): the highest version of each paper among the .md files of a folder, cleaned, non-empty,
    and newer than the version in ``stored`` (key, version)."""
    f = spark.read.text(root, wholetext=True, pathGlobFilter="*.md").withColumn("path", F.col("_metadata.file_path"))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), "\\.md$", "")
    f = f.select(stem_key(stem).alias("key"), stem_version(stem).alias("version"), "path", clean_lines(F.col("value")).alias("text"))
    w = Window.partitionBy("key").orderBy(F.col("version").desc(), "path")
    f = f.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r").filter(F.trim("text") != "")
    if stored is not None:
        f = f.join(stored.select("key", F.col("version").alias("_v")), "key", "left").filter("_v IS NULL OR version > _v").drop("_v")
    return f


def jsonl_texts(spark: SparkSession, path: str, field: str = "text", z: float = 2.0) -> DataFrame:
    """Texts of a JSON-lines file whose log2 length lies within z robust deviations of the median."""
    x = spark.read.schema(f"{field} string").json(path).filter(F.length(F.trim(field)) > 0).select(F.col(field).alias("text")).withColumn("x", F.log2(F.length("text")))
    m = x.agg(F.median("x").alias("m"))
    a = x.crossJoin(F.broadcast(m)).agg(F.first("m").alias("m"), F.median(F.abs(F.col("x") - F.col("m"))).alias("mad"))  # one-row tables
    return x.crossJoin(F.broadcast(a)).filter(F.abs(F.col("x") - F.col("m")) <= F.greatest(z * 1.4826 * F.col("mad"), F.lit(1e-9))).select("text")


def mixed(parts: list[tuple[str, DataFrame, str, str, int]]) -> DataFrame:
    """(source, n, text): several corpora one after the other, every stride-th row of each by key order, blanks dropped.
    ``parts`` has (source, rows, key, text, stride)."""
    out = None
    for i, (source, df, key, text, stride) in enumerate(parts):
        x = df.filter(F.length(F.trim(text)) > 0).select(F.lit(i).alias("part"), F.lit(source).alias("source"), F.col(key).cast("string").alias("k"), F.col(text).alias("text"))
        if stride > 1:
            x = x.filter(F.pmod(F.xxhash64("k"), F.lit(stride)) == 0)
        out = x if out is None else out.unionByName(x)
    return out


def read_titles(spark: SparkSession, path: str, have: DataFrame | None = None) -> DataFrame:
    """(paper, title) of a CSV file with a header; papers in ``have`` are left out."""
    t = spark.read.schema("paper string, title string").option("header", True).csv(path).filter("paper IS NOT NULL").dropDuplicates(["paper"])
    return t.join(have.select("paper"), "paper", "left_anti") if have is not None else t


def write_graph_csv(nodes: DataFrame, edges: DataFrame, root: str) -> dict[str, int]:
    """Writes nodes (id, ...) and edges (a, b, ...) as CSV with headers; raises ValueError if an edge dangles. Returns the row counts."""
    ends = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id"))).distinct()
    lost = ends.join(nodes.select("id"), "id", "left_anti").count()
    if lost:
        raise ValueError(f"{lost} edge ends are no nodes")
    nodes.write.mode("overwrite").option("header", True).csv(f"{root}/nodes")
    edges.write.mode("overwrite").option("header", True).csv(f"{root}/edges")
    return {"nodes": nodes.count(), "edges": edges.count()}
