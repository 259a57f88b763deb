"""Items that appear together: pair counts over baskets with large-basket blocking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def npmi(n_ab: Column, n_a: Column, n_b: Column, n: Column) -> Column:
    """Normalised pointwise mutual information from counts; 0 for a pair that is in every basket."""
    pab = n_ab / n
    val = F.log(pab / ((n_a / n) * (n_b / n))) / -F.log(pab)
    return F.when(n_ab >= n, F.lit(0.0)).otherwise(val)


def distinct_mentions(df: DataFrame, scope: str, basket: str, item: str, count: str | None) -> DataFrame:
    """One row per (scope, basket, item) that is really named: keys not null, count above 0."""
    keep = F.col(scope).isNotNull() & F.col(basket).isNotNull() & F.col(item).isNotNull()
    if count:
        keep &= F.col(count) > 0
    return df.filter(keep).select(scope, basket, item).distinct()


def pair_counts(mentions: DataFrame, scope: str, basket: str, item: str, *, chunk_items: int = 256) -> DataFrame:
    """Number of baskets that hold both items, for each pair a < b that shares one.

    ``mentions`` has one row per (scope, basket, item). A basket of up to ``chunk_items`` items is
    one array whose pairs are unfolded in place. A larger basket is split into item chunks by hash;
    each pair of chunks is a row of its own, so the product of one huge basket is spread over many
    tasks, and no array exceeds about ``chunk_items``. Both kinds are added up with map-side
    combining, so a pair is shuffled once per task, not once per basket.
    """
    sized = mentions.groupBy(scope, basket).agg(F.count(F.lit(1)).alias("_n"))
    big = sized.filter(F.col("_n") > chunk_items)
    small_b = (
        mentions.join(big.select(scope, basket), [scope, basket], "left_anti")
        .groupBy(scope, basket).agg(F.sort_array(F.collect_list(item)).alias("_items"))
        .filter(F.size("_items") > 1)
    )
    small = (
        small_b.select(scope, "_items", F.posexplode("_items").alias("_i", "a"))
        .filter(F.expr("_i + 1 < size(_items)"))
        .select(scope, "a", F.explode(F.expr("slice(_items, _i + 2, size(_items))")).alias("b"))
    )
    chunks = (
        mentions.join(big, [scope, basket])
        .withColumn("_k", F.ceil(F.col("_n") / chunk_items).cast("int"))
        .withColumn("_c", F.pmod(F.xxhash64(item), F.col("_k")).cast("int"))
        .groupBy(scope, basket, "_c").agg(F.max("_k").alias("_k"), F.sort_array(F.collect_list(item)).alias("_items"))
    )
    left = chunks.select(scope, basket, F.col("_c").alias("_c1"), F.explode(F.expr("sequence(_c, _k - 1)")).alias("_c2"), F.col("_items").alias("_l"))
    right = chunks.select(scope, basket, F.explode(F.expr("sequence(0, _c)")).alias("_c1"), F.col("_c").alias("_c2"), F.col("_items").alias("_r"))
    x = F.explode("_l").alias("x")
    large = (
        left.join(right, [scope, basket, "_c1", "_c2"])
        .select(scope, "_c1", "_c2", "_r", x)
        .select(scope, "_c1", "_c2", "x", F.explode("_r").alias("y"))
        .filter(((F.col("_c1") < F.col("_c2")) & (F.col("x") != F.col("y"))) | (F.col("x") < F.col("y")))
        .select(scope, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    )
    return small.unionByName(large).groupBy(scope, "a", "b").agg(F.count(F.lit(1)).alias("n_shared"))


def associations(df: DataFrame, scope: str, basket: str, item: str, count: str | None = None, *, min_shared: int = 1, chunk_items: int = 256) -> DataFrame:
    """Pairs of items named together in at least ``min_shared`` baskets of a scope, with npmi and lift.

    Nulls in a key, and counts null or not above 0, are no mentions; repeated rows count once; a
    basket without any mention is not counted; an empty table gives no rows. Items in fewer than
    ``min_shared`` baskets are left out before pairs are formed, which loses no pair. Other columns
    of ``df`` are ignored.
    """
    m = distinct_mentions(df, scope, basket, item, count)
    total = m.groupBy(scope, basket).agg(F.lit(1).alias("_o")).groupBy(scope).agg(F.count(F.lit(1)).alias("n"))
    freq = m.groupBy(scope, item).agg(F.count(F.lit(1)).alias("n_item"))
    if min_shared > 1:
        m = m.join(freq.filter(F.col("n_item") >= min_shared).select(scope, item), [scope, item], "left_semi")
    p = pair_counts(m, scope, basket, item, chunk_items=chunk_items).filter(F.col("n_shared") >= min_shared)
    fa = freq.select(scope, F.col(item).alias("a"), F.col("n_item").alias("n_a"))
    fb = freq.select(scope, F.col(item).alias("b"), F.col("n_item").alias("n_b"))
    p = p.join(fa, [scope, "a"]).join(fb, [scope, "b"]).join(total, scope)
    return p.select(
        scope, "a", "b", "n_shared", "n_a", "n_b", "n",
        npmi(F.col("n_shared"), F.col("n_a"), F.col("n_b"), F.col("n")).alias("npmi"),
        (F.col("n_shared") * F.col("n") / (F.col("n_a") * F.col("n_b"))).alias("lift"),
    )


def check_stored_edges(edges: DataFrame, pairs: DataFrame, builds: DataFrame) -> DataFrame:
    """Compares stored co_mention edges with rebuilt pairs.

    ``builds`` maps build_id to run_id. Reversed pairs are turned, repeated rows count once. The
    state of a pair is ok, stale (count or npmi differ, or npmi null), missing (not stored) or
    unfounded (stored, but the pair shares no basket that counts).
    """
    e = (
        edges.filter(F.col("kind") == "co_mention").filter(F.col("a").isNotNull() & F.col("b").isNotNull())
        .select("build_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("n_shared").alias("stored_shared"), F.col("npmi").alias("stored_npmi"))
        .groupBy("build_id", "a", "b").agg(F.max("stored_shared").alias("stored_shared"), F.max("stored_npmi").alias("stored_npmi"))
    )
    p = pairs.join(builds, "run_id").select("build_id", "a", "b", "n_shared", "npmi")
    j = e.join(p, ["build_id", "a", "b"], "full_outer")
    state = (
        F.when(F.col("stored_shared").isNull() & F.col("n_shared").isNotNull() & F.col("stored_npmi").isNull(), "missing")
        .when(F.col("n_shared").isNull(), "unfounded")
        .when((F.col("stored_shared") != F.col("n_shared")) | F.col("stored_npmi").isNull() | (F.abs(F.col("stored_npmi") - F.col("npmi")) > 1e-3), "stale")
        .otherwise("ok")
    )
    return j.select("build_id", "a", "b", "n_shared", "stored_shared", F.round("npmi", 6).alias("npmi"), state.alias("state"))
