"""Descriptions of communities: greedy choices over bounded candidate lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _greedy(df: DataFrame, group: str, item: str, score: str, k: int, clash) -> DataFrame:
    """(group, item, score, rank): the first k items of each bounded list, best first, that clash with none kept."""
    gt, it_, st = (df.schema[c].dataType.simpleString() for c in (group, item, score))
    lists = df.groupBy(group).agg(F.collect_list(F.struct(item, score)).alias("l"))

    def work(it):
        for pdf in it:
            out = []
            for g, l in zip(pdf[group], pdf.l):
                kept: list = []
                for r in sorted(l, key=lambda r: (-r[score], r[item])):
                    if not any(clash(r[item], x) for x in kept):
                        kept.append(r[item])
                        out.append((g, r[item], r[score], len(kept)))
                        if len(kept) == k:
                            break
            yield pd.DataFrame(out, columns=[group, item, score, "rank"])

    return lists.mapInPandas(work, f"{group} {gt}, {item} {it_}, {score} {st}, rank int")


def suppress_contained(df: DataFrame, group: str, item: str, score: str, k: int) -> DataFrame:
    """Items of which none contains, or sits inside, a better one of its group."""
    return _greedy(df, group, item, score, k, lambda a, b: a in b or b in a)


def distinct_surfaces(df: DataFrame, group: str, item: str, score: str, k: int) -> DataFrame:
    """Items whose words are neither a subset nor a superset of a better one's."""
    return _greedy(df, group, item, score, k, lambda a, b: set(a.split()) <= set(b.split()) or set(b.split()) <= set(a.split()))


def greedy_independent(reach: DataFrame, sym: DataFrame) -> DataFrame:
    """(build_id, seed, node, rank): nodes of each neighbourhood, best score first, none joined to one chosen before."""
    inner = sym.select("build_id", F.col("a").alias("node"), F.col("b").alias("other"))
    e = reach.select("build_id", "seed", "node").join(inner, ["build_id", "node"]).join(reach.select("build_id", "seed", F.col("node").alias("other")), ["build_id", "seed", "other"])
    nb = e.groupBy("build_id", "seed", "node").agg(F.collect_set("other").alias("nb"))
    l = reach.join(nb, ["build_id", "seed", "node"], "left").groupBy("build_id", "seed").agg(F.collect_list(F.struct("node", F.round("score", 9).alias("score"), "nb")).alias("l"))

    def work(it):
        for pdf in it:
            out = []
            for b, s, l in zip(pdf.build_id, pdf.seed, pdf.l):
                banned, rank = set(), 0
                for r in sorted(l, key=lambda r: (-r["score"], r["node"])):
                    if r["node"] not in banned:
                        rank += 1
                        out.append((b, s, r["node"], rank))
                        banned.update(r["nb"] if r["nb"] is not None else ())
            yield pd.DataFrame(out, columns=["build_id", "seed", "node", "rank"])

    return l.mapInPandas(work, "build_id long, seed int, node int, rank int")


def exemplars(df: DataFrame, key: str, group: str, vec: str, k: int, lam: float = 0.5, pool: int = 2000) -> DataFrame:
    """(group, key, rank): of each group the row nearest its centroid, then rows by similarity to the centroid less
    ``lam`` times the largest similarity to those chosen. The choice is among the ``pool`` rows nearest the
    centroid, so that no task holds an unbounded group."""
    from sectloom.functions.vec import dot, norm
    from sectloom.operators.dense import centroids
    from sectloom.operators.lexical import top

    j = df.join(centroids(df, group, vec), group).select(group, key, vec, F.round(dot(vec, "mu") / (norm(vec) * norm("mu")), 6).alias("s"))
    near = top(j, [group], [F.col("s").desc(), F.col(key)], pool)
    kt, gt = df.schema[key].dataType.simpleString(), df.schema[group].dataType.simpleString()

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["s", key], ascending=[False, True], kind="stable")
        x = np.stack(pdf[vec].values).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        s, worst, left, out = pdf.s.values, np.zeros(len(pdf)), np.ones(len(pdf), bool), []
        for rank in range(1, min(k, len(pdf)) + 1):
            i = int(np.where(left, np.round(s - lam * worst, 9), -np.inf).argmax())
            out.append((pdf[group].iloc[0], pdf[key].iloc[i], rank))
            left[i] = False
            worst = np.maximum(worst, x @ x[i])
        return pd.DataFrame(out, columns=[group, key, "rank"])

    return near.groupBy(group).applyInPandas(work, f"{group} {gt}, {key} {kt}, rank int")
