"""Grouping records into similarity clusters: a grid of quantised features, dense cells, minimum labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sectloom.llm.vectors import matrix, sum_matrices, usable
from sectloom.plans.runtime import cut, release

#: Records from which the rotation's first guess comes; it is then improved over all records until it stands still.
SAMPLE = 20_000
#: The rotation stands still when a pass over all records raises its score by less than this share.
STILL = 1e-6
#: A cell is dense if it holds this share of the mean number of records per axis, and this many records at least.
DENSE_SHARE, DENSE_LEAST = 0.05, 3
#: A record clearly belongs to a cluster if its main feature exceeds the cell width, and its second this share of the main one at most.
SECOND = 0.75
TYPICAL = 5


def signal_axes(gram: np.ndarray, n: int) -> np.ndarray:
    """Eigenvectors of the second moments (columns) whose eigenvalues exceed what noise alone gives: the
    Marchenko-Pastur edge of the rest's mean."""
    d = len(gram)
    val, vec = np.linalg.eigh(gram / max(1, n))
    order = np.argsort(val)[::-1]
    val, vec = val[order], vec[:, order]
    k = 0
    for _ in range(50):
        rest = max(d - k, 1)
        noise = val[k:].sum() / rest
        edge = 1.1 * noise * (1 + np.sqrt(rest / max(1, n))) ** 2
        new = int((val > edge).sum())
        if new == k:
            break
        k = new
    return vec[:, : max(1, min(k, d))]


def turned(pull: np.ndarray) -> np.ndarray:
    """The orthogonal matrix nearest ``pull``."""
    u, _, vt = np.linalg.svd(pull)
    return u @ vt


def first_rotation(y: np.ndarray) -> np.ndarray:
    """A rotation (columns) that makes the features of some records peaked: the fixed point of w <- E[y (w'y)^3],
    all axes at once; of several starts the best."""
    k = y.shape[1]
    best, top = np.eye(k), -np.inf
    for seed in range(6):
        w = np.eye(k) if seed == 0 else np.linalg.qr(np.random.default_rng(seed).normal(size=(k, k)))[0]
        last = -np.inf
        while True:
            p = y @ w
            score = float((p**4).sum())
            if score - last <= STILL * abs(score):
                break
            last, w = score, turned(y.T @ p**3)
        if score > top:
            best, top = w, score
    return best


def rotation(y: DataFrame, key: str, n: int, k: int) -> np.ndarray:
    """The same fixed point over all records: passes of one k x k sum each, from the guess of a sample by a hash of
    the key, until the score stands still. Scores only rise, so the passes end."""
    share = min(1.0, 1.3 * SAMPLE / max(1, n))
    some = y.filter(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(share * 1_000_000)).limit(SAMPLE).select("y").toPandas()
    w = first_rotation(np.stack(some.y.values).astype(np.float64)) if len(some) else np.eye(k)
    last = -np.inf
    while True:

        def pull(pdf: pd.DataFrame) -> np.ndarray:
            m = np.stack(pdf.y.values).astype(np.float64)
            return m.T @ (m @ w) ** 3

        g, _ = sum_matrices(y.select("y"), pull, k)
        score = float((g * w).sum())
        if score - last <= STILL * abs(score):
            return w
        last, w = score, turned(g)


def features(df: DataFrame, key: str, vec: str, dim: int) -> tuple[DataFrame, int]:
    """(key, y): features of every usable vector on rotated signal axes, and the number of axes. All
    moments are taken over all records."""
    kt = df.schema[key].dataType.simpleString()
    u = usable(df, key, vec, dim)

    def gram(pdf: pd.DataFrame) -> np.ndarray:
        x = matrix(pdf[vec], dim)
        return x.T @ x

    g, n = sum_matrices(u.select(vec), gram, dim)
    axes = signal_axes(g, n).astype(np.float32)
    k = axes.shape[1]

    def project(it):
        for pdf in it:
            yield pd.DataFrame({key: pdf[key], "y": list(matrix(pdf[vec], dim) @ axes)})

    y = cut(u.mapInPandas(project, f"{key} {kt}, y array<float>"), "axes")
    w = rotation(y, key, n, k)

    def third(pdf: pd.DataFrame) -> np.ndarray:
        return ((np.stack(pdf.y.values).astype(np.float64) @ w) ** 3).sum(0, keepdims=True)

    sign, _ = sum_matrices(y.select("y"), third, 1)
    w = (w * np.where(sign[0] < 0, -1.0, 1.0)).astype(np.float32)

    def turn(it):
        for pdf in it:
            yield pd.DataFrame({key: pdf[key], "y": list(np.stack(pdf.y.values) @ w) if len(pdf) else []})

    return y.mapInPandas(turn, f"{key} {kt}, y array<float>"), k


def propagate(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(cell, label): the least cell of each connected component, by minimum labels to convergence."""
    lab = cut(nodes.select("cell", F.col("cell").alias("label")), "labels")
    while True:
        low = edges.join(lab, edges.b == lab.cell).groupBy(F.col("a").alias("cell")).agg(F.min("label").alias("low"))
        new = cut(lab.join(low, "cell", "left").select("cell", F.least("label", F.coalesce("low", "label")).alias("label"), F.coalesce(F.col("low") < F.col("label"), F.lit(False)).alias("moved")), "labels")
        moved = new.filter("moved").limit(1).count()
        release(lab)
        lab = new
        if not moved:
            return lab.select("cell", "label")


def grid_clusters(df: DataFrame, key: str, vec: str, dim: int) -> DataFrame:
    """(key, cell, cluster, main, clear): the cluster of every usable record (null: near no cluster), its
    grid cell, its main feature and whether it clearly belongs.

    Features are the records' coordinates on axes along which the collection is peaked. They are
    quantised with a width of half the median main feature; a cell is named by its coordinates that
    are not 0, so the all-zero cell is background. Cells are counted, dense cells that differ by one
    step in one coordinate are joined, and minimum labels propagated. A record in no dense cell
    belongs to the cluster of its main coordinate's cell. Dense cells number at most axes /
    DENSE_SHARE, whatever the data; only they are joined. Copies fall into one cell and are counted
    with map-side combining. Rows that are not usable give no row; an empty table gives none.
    """
    y, k = features(df, key, vec, dim)
    y = cut(y.withColumn("main", F.array_max("y")), "features")
    stat = y.agg(F.percentile_approx("main", 0.5, 10000).alias("m"), F.count(F.lit(1)).alias("n")).first()
    width = float(stat.m or 1.0) / 2
    least = max(DENSE_LEAST, int(DENSE_SHARE * stat.n / k))
    q = F.transform("y", lambda x: F.round(x / width).cast("int"))
    named = F.array_join(F.filter(F.transform(q, lambda x, i: F.when(x != 0, F.concat(i.cast("string"), F.lit(":"), x.cast("string"))).otherwise(F.lit(""))), lambda s: s != ""), ",")
    axis = F.array_position(F.col("y"), F.col("main")) - 1
    second = F.element_at(F.sort_array("y", asc=False), 2) if k > 1 else F.lit(0.0)
    r = y.select(
        key, "main", named.alias("cell"), axis.cast("int").alias("axis"),
        F.concat(axis.cast("string"), F.lit(":"), F.round(F.col("main") / width).cast("int").cast("string")).alias("main_cell"),
        ((F.col("main") >= width) & (second <= SECOND * F.col("main"))).alias("clear"),
    )
    r = cut(r, "cells")
    dense = cut(r.filter("cell != ''").groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least), "dense")
    # coordinates of a dense cell, one step up or down in each; axes at 0 become 1 or -1
    m = F.map_from_entries(F.transform(F.split("cell", ","), lambda s: F.struct(F.split(s, ":")[0].cast("int"), F.split(s, ":")[1].cast("int"))))
    near = dense.select("cell", m.alias("m"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("i")).select("cell", "m", "i", F.explode(F.array(F.lit(-1), F.lit(1))).alias("s"))
    moved = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.struct(i.alias("i"), (F.coalesce(F.element_at("m", i), F.lit(0)) + F.when(i == F.col("i"), F.col("s")).otherwise(0)).alias("v")))
    other = F.array_join(F.transform(F.filter(moved, lambda t: t["v"] != 0), lambda t: F.concat(t["i"].cast("string"), F.lit(":"), t["v"].cast("string"))), ",")
    edges = near.select(F.col("cell").alias("a"), other.alias("b")).join(dense.select(F.col("cell").alias("b")), "b", "left_semi")
    labels = propagate(cut(edges, "edges"), dense)
    main = labels.select(F.col("cell").alias("main_cell"), F.col("label").alias("by_main"))
    # the main cell may be next to a dense one of the same axis
    steps = [labels.filter(F.size(F.split("cell", ",")) == 1).select(F.concat(F.split("cell", ":")[0], F.lit(":"), (F.split("cell", ":")[1].cast("int") + s).cast("string")).alias("main_cell"), F.col("label").alias("by_next")) for s in (-1, 1)]
    next_ = steps[0].unionByName(steps[1]).groupBy("main_cell").agg(F.min("by_next").alias("by_next"))
    j = r.join(labels, "cell", "left").join(main, "main_cell", "left").join(next_, "main_cell", "left")
    found = F.coalesce("label", F.when(F.col("main") >= width, F.coalesce("by_main", "by_next")))
    return j.select(key, "cell", found.alias("cluster"), "main", (F.col("clear") & found.isNotNull()).alias("clear"))


def cluster_majority(members: DataFrame, stored: DataFrame, key: str, community: str) -> DataFrame:
    """(cluster, community, votes): the community most clear members of each cluster carry; -1 and null carry none. Ties: the lesser number."""
    j = members.filter("clear").join(stored.select(key, community), key).filter(F.col(community).isNotNull() & (F.col(community) >= 0))
    c = j.groupBy("cluster", F.col(community).alias("community")).agg(F.count(F.lit(1)).alias("votes"))
    w = Window.partitionBy("cluster").orderBy(F.col("votes").desc(), "community")
    return c.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def describe(members: DataFrame, key: str, typical: int = TYPICAL) -> DataFrame:
    """(cluster, size, densest_cell, typical): size of each cluster and the records of its densest cell with the largest main feature."""
    m = members.filter(F.col("cluster").isNotNull())
    sizes = m.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    cells = m.groupBy("cluster", "cell").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("cluster").orderBy(F.col("_n").desc(), "cell")
    top = cells.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("cluster", F.col("cell").alias("densest_cell"))
    inside = m.join(top, (m.cluster == top.cluster) & (m.cell == top.densest_cell), "left_semi")
    by = Window.partitionBy("cluster").orderBy(F.col("main").desc(), key)  # limited before the shuffle
    best = inside.withColumn("_r", F.row_number().over(by)).filter(F.col("_r") <= typical).groupBy("cluster").agg(F.array_sort(F.collect_list(key)).alias("typical"))
    return sizes.join(top, "cluster").join(best, "cluster")
