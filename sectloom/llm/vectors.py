"""Vectors that can be compared: usable, counted once, and aggregates over all of them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectloom.plans.runtime import cut, size_bound

#: Repeated keys up to this number are broadcast.
REPEATS = 1_000_000
#: Partial sums that are added up together.
FAN = 512


def usable(df: DataFrame, key: str, vec: str, dim: int) -> DataFrame:
    """(key, vec) of rows whose vector has ``dim`` finite numbers, not all zero; keys delivered more than
    once count once (the least of their vectors). Null keys and null vectors are left out.

    Only rows of repeated keys are grouped; the others are not shuffled unless there are more than REPEATS such keys.
    """
    ok = F.col(key).isNotNull() & (F.size(vec) == dim) & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vec, lambda x: x != 0)
    u = df.select(key, vec).filter(ok)
    more = cut(df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(key), "repeated")
    if size_bound(more, REPEATS):
        more = F.broadcast(more)
    once = u.join(more, key, "left_anti")
    again = u.join(more, key, "left_semi").groupBy(key).agg(F.min(vec).alias(vec))
    return once.unionByName(again)


def matrix(col: pd.Series, dim: int) -> np.ndarray:
    """Rows of unit length."""
    x = np.concatenate([np.asarray(v, np.float32) for v in col.values]).reshape(-1, dim) if len(col) else np.empty((0, dim), np.float32)
    big = np.abs(x).max(1, keepdims=True) if len(x) else np.ones((0, 1), np.float32)
    x = x / big  # so that no square overflows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def sum_matrices(df: DataFrame, part: Callable[[pd.DataFrame], np.ndarray], rows: int) -> tuple[np.ndarray, int]:
    """Sum over all batches of the matrix that ``part`` makes of a batch, and the number of rows.

    Each task adds up its batches and emits its matrix by rows; rows are added in parallel, in two steps, so
    that no group holds a row of every task, and only the sum, whose size does not depend on the data,
    comes to the driver.
    """

    def partial(it):
        total, n = None, 0
        for pdf in it:
            if len(pdf):
                m = part(pdf)
                total = m if total is None else total + m
                n += len(pdf)
        if total is not None:
            yield pd.DataFrame({"i": np.arange(-1, rows, dtype=np.int32), "v": [np.array([float(n)]), *total.astype(np.float64)]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [pdf.i.iloc[0]], "v": [np.sum(np.stack(pdf.v.values), axis=0)]})

    cols = "i int, v array<double>"
    part_ = df.mapInPandas(partial, cols)
    tasks = df.rdd.getNumPartitions()
    if tasks > FAN:
        part_ = part_.withColumn("p", F.floor(F.spark_partition_id() / FAN)).groupBy("i", "p").applyInPandas(add, cols)
    got = part_.groupBy("i").applyInPandas(add, cols).collect()
    by = {r.i: np.array(r.v) for r in got}
    if not by:
        return np.zeros((rows, rows)), 0
    return np.stack([by[i] for i in range(rows)]), int(by[-1][0])
