"""Versioned builds: publishing, superseding, replacing, incremental rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def newest(df: DataFrame, keys: list[str], version: str, tie: str) -> DataFrame:
    """The row of the highest version of each key; ties: the highest ``tie``."""
    w = Window.partitionBy(*keys).orderBy(F.col(version).desc(), F.col(tie).desc())
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def upsert(stored: DataFrame, batch: DataFrame, keys: list[str], version: str, tie: str) -> DataFrame:
    """Stored rows with a batch applied: a higher version replaces, the same or a lower one is ignored."""
    new = newest(batch, keys, version, tie)
    old = stored.select(*keys, F.col(version).alias("_v")).groupBy(*keys).agg(F.max("_v").alias("_v"))
    win = new.join(old, keys, "left").filter(F.col("_v").isNull() | (F.col(version) > F.col("_v"))).drop("_v")
    return stored.join(win.select(*keys), keys, "left_anti").unionByName(win.select(*stored.columns))


def intervals(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Rows with valid_from and valid_to: each is valid until the key's next; the last is open."""
    w = Window.partitionBy(*keys).orderBy(at, *[c for c in df.columns if c not in (*keys, at)][:1])
    return df.withColumn("valid_from", F.col(at)).withColumn("valid_to", F.lead(at).over(w))


def as_of(df: DataFrame, when) -> DataFrame:
    """Rows whose interval contains an instant; an open end contains all later ones."""
    return df.filter((F.col("valid_from") <= when) & (F.col("valid_to").isNull() | (F.col("valid_to") > when)))


def violations(nodes: DataFrame, edges: DataFrame, runs: DataFrame) -> DataFrame:
    """(rule, n): number of rows that break each rule of the graph tables."""
    key = ["run_id"]
    checks = {
        "edge_canonical": edges.filter("src >= dst"),
        "edge_interval": edges.filter("valid_to < valid_from"),
        "edge_unique": edges.groupBy("run_id", "src", "dst").count().filter("count > 1"),
        "dangling_edge": edges.select("run_id", F.explode(F.array("src", "dst")).alias("ord")).join(nodes.select("run_id", "ord"), ["run_id", "ord"], "left_anti"),
        "one_live_run": runs.filter("superseded_at IS NULL").groupBy("label").count().filter("count > 1"),
        "run_size": runs.filter("n_chunks < 10"),
        "node_without_run": nodes.join(runs.select(*key), key, "left_anti"),
    }
    out = None
    for rule, df in checks.items():
        c = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(rule).alias("rule"), "n")
        out = c if out is None else out.unionByName(c)
    return out


def publish(spark: SparkSession, root: str, build: str, tables: dict[str, DataFrame], checks: dict[str, int]) -> None:
    """Writes a build's tables to a folder of its own, counts them, and only then appends a manifest row that
    makes it live. ``checks`` gives the rows each table must have; a mismatch raises ValueError and
    leaves the live build as it was."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}/build={build}")
    for name, want in checks.items():
        got = spark.read.parquet(f"{root}/{name}/build={build}").count()
        if got != want:
            raise ValueError(f"{name} has {got} rows, not {want}")
    spark.createDataFrame([(build,)], "build string").withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{root}/_manifest")


def live_build(spark: SparkSession, root: str) -> str | None:
    """The build that was published last, or None."""
    try:
        return spark.read.parquet(f"{root}/_manifest").agg(F.max_by("build", "at")).first()[0]
    except Exception as e:  # no manifest yet
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
