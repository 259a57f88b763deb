"""Dense vectors: centring, exact block search, genre axes, hashed embedding."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sectloom.functions.vec import dot, norm
from sectloom.operators.lexical import top
from sectloom.plans.runtime import cut


def hashed_embedding(df: DataFrame, key: str, tokens, dim: int) -> DataFrame:
    """(key, vec): counts of tokens by crc32 modulo ``dim``."""
    t = df.select(key, F.explode(tokens).alias("t")).select(key, (F.crc32("t") % dim).cast("int").alias("i"))
    c = t.groupBy(key, "i").agg(F.count(F.lit(1)).cast("double").alias("c")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("i", "c"))).alias("m"))
    return c.select(key, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.element_at("m", i.cast("int")), F.lit(0.0))).alias("vec"))


def mean_vector(df: DataFrame, vec: str) -> DataFrame:
    """One row: the mean of all vectors."""
    m = df.select(F.posexplode(vec).alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return m.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mu"))


def centred(df: DataFrame, key: str, vec: str) -> DataFrame:
    """(key, vec): vectors less their mean, at unit length; the mean is one row."""
    x = df.select(key, vec).crossJoin(F.broadcast(mean_vector(df, vec)))
    c = x.select(key, F.zip_with(vec, "mu", lambda a, m: a.cast("double") - m).alias("vec"))
    return c.withColumn("n", norm("vec")).filter("n > 0").select(key, F.transform("vec", lambda v: v / F.col("n")).alias("vec"))


def block_topk(base: DataFrame, queries: DataFrame, key: str, vec: str, k: int, block: int = 2048) -> DataFrame:
    """(query, key, s, rank): exact search of all rows for every stated query, block by block: blocks of
    queries meet blocks of rows as matrix products, and only each block's best k are kept.

    Blocks are numbered by hash, so their number grows with the rows and no task holds more than two.
    """
    kt = base.schema[key].dataType.simpleString()
    nb, nq = max(1, -(-base.count() // block)), max(1, -(-queries.count() // block))
    b = base.select(key, vec, F.pmod(F.xxhash64(key), F.lit(nb)).cast("int").alias("bb")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    q = queries.select(F.col(key).alias("_q"), F.transform(vec, lambda x: x + 0).alias("_w"), F.pmod(F.xxhash64(key), F.lit(nq)).cast("int").alias("qq")).withColumn("pb", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))))

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query": [], key: [], "s": []})
        x, y = np.stack(left[vec].values).astype(float), np.stack(right["_w"].values).astype(float)
        s = y @ x.T
        ids, qs = left[key].values, right["_q"].values
        s[qs[:, None] == ids[None, :]] = -np.inf
        c = np.argpartition(-s, min(k, s.shape[1] - 1), axis=1)[:, : k + 1] if s.shape[1] > k else np.tile(np.arange(s.shape[1]), (len(s), 1))
        v = np.take_along_axis(s, c, 1)
        out = pd.DataFrame({"query": np.repeat(qs, c.shape[1]), key: ids[c].ravel(), "s": v.ravel()})
        return out[np.isfinite(out.s)]

    r = b.groupBy("qb", "bb").cogroup(q.groupBy("qq", "pb")).applyInPandas(work, f"query {kt}, {key} {kt}, s double")
    return top(r.withColumn("s", F.round("s", 6)), ["query"], [F.col("s").desc(), F.col(key)], k)


def block_pairs(base: DataFrame, key: str, vec: str, carry: list[str], part, schema: str, queries: DataFrame | None = None, block: int = 2048) -> DataFrame:
    """What ``part(s, left, right)`` makes of each block of the products of all pairs of rows: ``s`` has a row for each
    of ``left`` and a column for each of ``right``, NaN where the pair does not count (key not below the other's).
    Only what ``part`` returns leaves a task, so counts and sums stay small. With ``queries`` the rows of ``left``
    are those, and only a row's pair with itself does not count."""
    n = max(1, -(-base.count() // block))
    home = lambda: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    right = base.select(key, F.col(vec).alias("_v"), *carry, home().alias("_rb")).withColumn("_lb", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    src = base if queries is None else queries
    left = src.select(F.col(key).alias("_k"), F.transform(vec, lambda x: x + 0).alias("_w"), *[F.col(c).alias(f"_{c}") for c in carry], home().alias("_lb2")).withColumn("_rb2", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    right = right.withColumn("_b", F.col("_lb").cast("long") * n + F.col("_rb"))
    left = left.withColumn("_b2", F.col("_lb2").cast("long") * n + F.col("_rb2"))
    every = queries is not None

    def work(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame | None:
        if not len(l) or not len(r):
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        s = np.stack(l["_w"].values).astype(float) @ np.stack(r["_v"].values).astype(float).T
        a, b = l["_k"].values[:, None], r[key].values[None, :]
        s[a == b if every else a >= b] = np.nan
        return part(s, l, r)

    return left.groupBy("_b2").cogroup(right.groupBy("_b")).applyInPandas(work, schema)


def similarity_counts(base: DataFrame, key: str, vec: str, digits: int, queries: DataFrame | None = None) -> DataFrame:
    """(s, n): number of pairs at each similarity, rounded to ``digits``: at most 2 * 10**digits + 1 rows."""

    def part(s, l, r):
        v, n = np.unique(np.rint(s[~np.isnan(s)] * 10**digits).astype(np.int64), return_counts=True)
        return pd.DataFrame({"bin": v, "n": n})

    return block_pairs(base, key, vec, [], part, "bin long, n long", queries).groupBy("bin").agg(F.sum("n").alias("n")).select(F.round(F.col("bin") / 10**digits, digits).alias("s"), "n")


def strongest_pairs(base: DataFrame, key: str, vec: str, most: int) -> DataFrame:
    """(a, b, s): the ``most`` pairs of largest similarity, ties by (a, b). Counts give the similarity at which the number is
    reached; only pairs of at least that are made, and only those that tie there are ranked together."""
    c = similarity_counts(base, key, vec, 6)
    w = Window.orderBy(F.col("s").desc())  # over the distinct similarities, 2 million at most
    at = c.withColumn("above", F.sum("n").over(w) - F.col("n")).filter(F.col("above") < most).agg(F.min_by("s", "s").alias("s"), F.max("above").alias("above")).first()
    if at is None or at.s is None:
        return base.select(F.col(key).alias("a"), F.col(key).alias("b"), F.lit(0.0).alias("s")).limit(0)

    def part(s, l, r):
        s = np.round(s, 6)
        i, j = np.nonzero(s >= at.s)  # NaN is not
        return pd.DataFrame({"a": l["_k"].values[i], "b": r[key].values[j], "s": s[i, j]})

    kt = base.schema[key].dataType.simpleString()
    p = block_pairs(base, key, vec, [], part, f"a {kt}, b {kt}, s double")
    tied = p.filter(F.col("s") == at.s).withColumn("_r", F.row_number().over(Window.orderBy("a", "b"))).filter(F.col("_r") <= most - at.above).drop("_r")
    return p.filter(F.col("s") > at.s).unionByName(tied)


def cell_topk(df: DataFrame, key: str, vec: str, k: int, *, cells: int, probe: int, sample: int = 20_000, most: int = 4096) -> DataFrame:
    """(query, key, s, rank): approximate neighbours of every row: rows lie in the cell of the nearest of ``cells``
    centroids (fitted on ``sample`` rows by hash), and every row is compared with the rows of its ``probe`` nearest
    cells. Cells of more than ``most`` rows are cut, and the rows that ask come to every part, so no pair is lost."""
    kt = df.schema[key].dataType.simpleString()
    n = df.count()
    share = min(1.0, 1.3 * sample / max(1, n))
    some = df.filter(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(share * 1_000_000)).limit(sample).select(vec).toPandas()
    x = np.stack(some[vec].values).astype(float) if len(some) else np.zeros((1, 1))
    c = x[np.random.default_rng(0).permutation(len(x))[: min(cells, len(x))]]
    for _ in range(10):
        own = (x @ c.T - (c * c).sum(1) / 2).argmax(1)
        c = np.stack([x[own == i].mean(0) if (own == i).any() else c[i] for i in range(len(c))])

    def place(it):
        for pdf in it:
            if len(pdf):
                d = np.stack(pdf[vec].values).astype(float) @ c.T - (c * c).sum(1) / 2
                yield pdf.assign(near=list(np.argsort(-d, axis=1, kind="stable")[:, :probe].astype(np.int32)))

    placed = df.select(key, F.transform(vec, lambda v: v.cast("double")).alias(vec)).mapInPandas(place, f"{key} {kt}, {vec} array<double>, near array<int>")
    placed = cut(placed, "cells")
    parts = placed.groupBy(F.col("near")[0].alias("cell")).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("parts"))  # a row a cell
    rows = placed.withColumn("cell", F.col("near")[0]).join(F.broadcast(parts), "cell").select(key, vec, (F.col("cell").cast("long") * 1_000_000 + F.pmod(F.xxhash64(key), F.col("parts"))).alias("at"))
    ask = placed.select(F.col(key).alias("_q"), F.col(vec).alias("_w"), F.explode("near").alias("cell")).join(F.broadcast(parts), "cell").withColumn("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("_q", "_w", (F.col("cell").cast("long") * 1_000_000 + F.col("p")).alias("to"))

    def work(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(l) or not len(r):
            return pd.DataFrame({"query": [], key: [], "s": []})
        y, ids = np.stack(r[vec].values), r[key].values
        out = []
        for lo in range(0, len(l), 1024):
            q = l["_q"].values[lo : lo + 1024]
            s = np.stack(l["_w"].values[lo : lo + 1024]) @ y.T
            s[q[:, None] == ids[None, :]] = -np.inf
            o = np.argsort(-s, axis=1, kind="stable")[:, : k + 1]
            out.append(pd.DataFrame({"query": np.repeat(q, o.shape[1]), key: ids[o].ravel(), "s": np.take_along_axis(s, o, 1).ravel()}))
        z = pd.concat(out)
        return z[np.isfinite(z.s)]

    r = ask.groupBy("to").cogroup(rows.groupBy("at")).applyInPandas(work, f"query {kt}, {key} {kt}, s double")
    return top(r.withColumn("s", F.round("s", 6)), ["query"], [F.col("s").desc(), F.col(key)], k)


def gram_matrix(df: DataFrame, vec: str) -> DataFrame:
    """(i, j, s): second moments of the vectors, one row an entry."""
    x = df.select(F.posexplode(vec).alias("i", "a"), vec).select("i", "a", F.posexplode(vec).alias("j", "b"))
    return x.groupBy("i", "j").agg(F.sum(F.col("a").cast("double") * F.col("b").cast("double")).alias("s"))


def without_axes(df: DataFrame, key: str, vec: str, group: str, k: int) -> DataFrame:
    """(key, share, vec): vectors without the k directions along which members of one group differ from
    their group's mean the most, and the share of their length that lay there. The directions come
    from a d x d matrix, whatever the number of rows."""
    mu = df.select(group, F.posexplode(vec).alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("x")).groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mu"))
    c = df.join(mu, group).select(F.zip_with(vec, "mu", lambda a, m: a.cast("double") - m).alias("vec"))
    g = gram_matrix(c, "vec").collect()
    d = 1 + max((r.i for r in g), default=0)
    m = np.zeros((d, d))
    for r in g:
        m[r.i, r.j] = r.s
    _, v = np.linalg.eigh(m)
    axes = v[:, ::-1][:, :k]
    kt = df.schema[key].dataType.simpleString()

    def work(it):
        for pdf in it:
            if len(pdf):
                x = np.stack(pdf[vec].values).astype(float)
                p = x @ axes
                share = (p**2).sum(1) / np.maximum((x**2).sum(1), 1e-12)
                yield pd.DataFrame({key: pdf[key], "share": share, "vec": list(x - p @ axes.T)})

    return df.select(key, vec).mapInPandas(work, f"{key} {kt}, share double, vec array<double>")


def centroids(df: DataFrame, group: str, vec: str) -> DataFrame:
    """(group, mu): mean vector of each group."""
    m = df.select(group, F.posexplode(vec).alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return m.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mu"))


def medoids(df: DataFrame, key: str, group: str, vec: str) -> DataFrame:
    """(group, key, s): the member of each group most like its centroid; ties: the lesser key."""
    j = df.join(centroids(df, group, vec), group).select(group, key, F.round(dot(vec, "mu") / (norm(vec) * norm("mu")), 6).alias("s"))
    w = Window.partitionBy(group).orderBy(F.col("s").desc(), key)
    return j.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
