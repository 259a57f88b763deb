"""Similarity graph: cuts on a Box-Cox scale, backbone, fusion of spaces."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sectloom.operators import boxcox


def z_scores(edges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Edges with z of their positive similarity on a Box-Cox scale fitted per group, and the group's excess kurtosis."""
    by = by or []
    e = edges.filter("s > 0").withColumn("_g", F.concat_ws("|", F.lit(""), *by))
    lo = e.groupBy("_g").agg(F.min("s").alias("lo"))
    x = e.join(lo, "_g").withColumn("x", F.col("s") - F.col("lo") + 1e-3)
    p = boxcox.powers(x.select(F.col("_g").alias("g"), "x"), "g").withColumnRenamed("g", "_g")
    t = x.join(p, "_g").withColumn("t", boxcox.transform(F.col("x"), F.col("lam")))
    m = t.groupBy("_g").agg(F.avg("t").alias("mu"), F.stddev_pop("t").alias("sd"), F.kurtosis("t").alias("kurt"))
    return t.join(m, "_g").withColumn("z", F.when(F.col("sd") > 0, (F.col("t") - F.col("mu")) / F.col("sd")).otherwise(0.0)).drop("x", "t", "lo", "mu", "sd", "_g")


def backbone(edges: DataFrame, k: int) -> DataFrame:
    """(a, b), a < b: edges among the k strongest of one of their ends; ties to the lesser neighbour."""
    both = edges.select("a", "b", "s").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "s"))
    w = Window.partitionBy("a").orderBy(F.col("s").desc(), "b")
    k_ = both.filter("s > 0").withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
    return k_.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def fuse(sparse: DataFrame, dense: DataFrame) -> DataFrame:
    """(a, b, provenance, zs, zd, strength): union of two edge sets (a, b, z) with where each edge comes from;
    strength is the mean z of the spaces that have it, scaled to 0..1 over all edges. An empty space
    leaves the other as it is."""
    j = sparse.select("a", "b", F.col("z").alias("zs")).join(dense.select("a", "b", F.col("z").alias("zd")), ["a", "b"], "full_outer")
    mean = (F.coalesce("zs", F.lit(0.0)) + F.coalesce("zd", F.lit(0.0))) / (F.col("zs").isNotNull().cast("int") + F.col("zd").isNotNull().cast("int"))
    prov = F.when(F.col("zs").isNull(), "dense").when(F.col("zd").isNull(), "sparse").otherwise("both")
    f = j.withColumn("m", mean).withColumn("provenance", prov)
    one = f.agg(F.min("m").alias("lo"), F.max("m").alias("hi"))
    return f.crossJoin(F.broadcast(one)).select("a", "b", "provenance", "zs", "zd", F.when(F.col("hi") > F.col("lo"), (F.col("m") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0).alias("strength"))  # one row


def bitmask_fuse(spaces: list[DataFrame]) -> DataFrame:
    """(a, b, sig, weight): edges of several spaces (a, b, z) with a bit for each space, and max(mean z, 0) + 0.001."""
    u = None
    for i, s in enumerate(spaces):
        x = s.select("a", "b", "z", F.lit(1 << i).alias("bit"))
        u = x if u is None else u.unionByName(x)
    return u.groupBy("a", "b").agg(F.bit_or("bit").alias("sig"), (F.greatest(F.avg("z"), F.lit(0.0)) + 1e-3).alias("weight"))


def null_cut(counts: DataFrame, k: float) -> DataFrame:
    """One row (lam, xmin, mu, sd, kurtosis, n, threshold) of a null given as counts (s, n) of positive similarities: powers by
    likelihood as in :mod:`boxcox`, and the similarity whose z is ``k``, from the transform's inverse; 1 if none reaches it."""
    cols = "lam double, xmin double, mu double, sd double, kurtosis double, n long, threshold double"

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x, n = pdf.s.values - pdf.s.min() + 1e-3, pdf.n.values.astype(float)
        total, logs = n.sum(), float((n * np.log(x)).sum())

        def curve(lam: float) -> np.ndarray:
            return np.log(x) if abs(lam) < 1e-9 else (x**lam - 1) / lam

        def llf(lam: float) -> float:
            y = curve(lam)
            mu = (n * y).sum() / total
            return (lam - 1) * logs - total / 2 * np.log(max((n * (y - mu) ** 2).sum() / total, 1e-300))

        grid, step = [g / 100 for g in boxcox.GRID], 0.25
        for finer in (*boxcox.FINER, None):
            lam = max(grid, key=lambda v: (llf(v), -abs(v - 1)))
            if finer:
                grid = [lam + i * finer for i in range(-10, 11)]
        y = curve(lam)
        mu = float((n * y).sum() / total)
        sd = float(np.sqrt((n * (y - mu) ** 2).sum() / total))
        kurt = float((n * (y - mu) ** 4).sum() / total / sd**4 - 3) if sd > 0 else 0.0
        at = mu + k * sd
        base = at if abs(lam) < 1e-9 else lam * at + 1
        back = np.exp(at) if abs(lam) < 1e-9 else (base ** (1 / lam) if base > 0 else np.inf)
        return pd.DataFrame({"lam": [lam], "xmin": [pdf.s.min()], "mu": [mu], "sd": [sd], "kurtosis": [kurt], "n": [int(total)], "threshold": [min(1.0, float(back + pdf.s.min() - 1e-3))]})

    return counts.groupBy(F.lit(0).alias("_g")).applyInPandas(fit, cols)
