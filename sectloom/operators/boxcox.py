"""Box-Cox powers by profile likelihood: a coarse grid, then two finer ones about the best power."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Powers that are tried first, in hundredths; then finer steps about the best of each group.
GRID = tuple(range(-300, 301, 25))
FINER = (0.025, 0.0025)


def transform(x: Column, lam: Column) -> Column:
    """The Box-Cox transform of x > 0."""
    return F.when(lam == 0, F.log(x)).otherwise((F.pow(x, lam) - 1) / F.when(lam == 0, 1.0).otherwise(lam))


def inverse(y: Column, lam: Column) -> Column:
    return F.when(lam == 0, F.exp(y)).otherwise(F.pow(F.greatest(lam * y + 1, F.lit(1e-12)), 1 / F.when(lam == 0, 1.0).otherwise(lam)))


def powers(df: DataFrame, by: str, x: str = "x") -> DataFrame:
    """(by, lam): the power of each group with the largest likelihood (lam - 1) sum ln x - n/2 ln var of the
    transform, to within 0.00125. Each grid is one aggregation; ties go to the power nearest 1. Values must
    be above 0."""
    e = df.select(by, F.col(x).cast("double").alias("x"))
    best = None
    for step in (None, *FINER):
        if best is None:
            t = e.select(by, "x", F.explode(F.array(*[F.lit(g / 100.0) for g in GRID])).alias("lam"))
        else:
            t = e.join(best, by).select(by, "x", F.explode(F.array(*[F.round(F.col("lam") + i * step, 4) for i in range(-10, 11)])).alias("lam"))
        s = t.groupBy(by, "lam").agg(F.count(F.lit(1)).alias("n"), F.sum(F.log("x")).alias("sl"), F.var_pop(transform(F.col("x"), F.col("lam"))).alias("v"))
        llf = F.round((F.col("lam") - 1) * F.col("sl") - F.col("n") / 2 * F.log(F.greatest("v", F.lit(1e-300))), 6)
        w = Window.partitionBy(by).orderBy(F.col("llf").desc(), F.abs(F.col("lam") - 1), "lam")
        best = s.withColumn("llf", llf).withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(by, "lam")
    return best


def fit_by(df: DataFrame, by: str, z: float = 2.0) -> DataFrame:
    """(by, lam, middle, hi) of values x: median and z robust deviations above it on the fitted scale, turned back."""
    p = powers(df, by)
    t = df.join(p, by).withColumn("t", transform(F.col("x"), F.col("lam")))
    m = t.groupBy(by, "lam").agg(F.median("t").alias("m"))
    a = t.join(m.select(by, "m"), by).groupBy(by).agg(F.median(F.abs(F.col("t") - F.col("m"))).alias("mad"))
    return m.join(a, by).select(by, "lam", F.round(inverse(F.col("m"), F.col("lam")), 4).alias("middle"), F.round(inverse(F.col("m") + z * 1.4826 * F.col("mad"), F.col("lam")), 4).alias("hi"))
