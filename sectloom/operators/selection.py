"""Greedy and rank-based term selection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sectloom.functions import stats
from sectloom.operators import lexical
from sectloom.plans.runtime import cut


def select_terms(post: DataFrame, key: str, k: int, candidates: int) -> DataFrame:
    """(rank, term, value): k terms, each the best by value less half its largest correlation with those chosen.

    Values are idf-weighted frequencies; presence correlations of the ``candidates`` best are counted
    in Spark, and the choice among them is one small task.
    """
    f = lexical.doc_freq(post).crossJoin(F.broadcast(lexical.corpus_size(post, key)))
    best = cut(f.withColumn("value", stats.idf(F.col("n"), F.col("df")) * F.sqrt("df")).orderBy(F.col("value").desc(), "term").limit(candidates).select("term", "df", "n", "value"), "best")
    p = post.select(key, "term").join(best.select("term"), "term")
    ab = p.select(key, F.col("term").alias("a")).join(p.select(key, F.col("term").alias("b")), key).filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_ab"))
    ab = ab.withColumn("one", F.lit(1)).groupBy("one").agg(F.collect_list(F.struct("a", "b", "n_ab")).alias("pairs"))  # at most candidates squared
    t = best.withColumn("one", F.lit(1)).groupBy("one").agg(F.collect_list(F.struct("term", "df", "n", "value")).alias("terms"))

    def choose(it):
        for pdf in it:
            for terms, pairs in zip(pdf.terms, pdf.pairs):
                terms = sorted(terms, key=lambda r: (-r["value"], r["term"]))
                names = [r["term"] for r in terms]
                at = {w: i for i, w in enumerate(names)}
                df = np.array([r["df"] for r in terms], float)
                n = float(terms[0]["n"]) if terms else 1.0
                co = np.zeros((len(names), len(names)))
                for r in pairs if pairs is not None else []:
                    i, j = at[r["a"]], at[r["b"]]
                    co[i, j] = co[j, i] = r["n_ab"]
                sd = np.sqrt(np.maximum(df * (n - df), 1e-9))
                phi = (n * co - np.outer(df, df)) / np.outer(sd, sd)
                v = np.array([r["value"] for r in terms])
                v = v / max(v.max(), 1e-9)
                worst, left, out = np.zeros(len(names)), np.ones(len(names), bool), []
                for rank in range(1, min(k, len(names)) + 1):
                    s = np.where(left, np.round(v - 0.5 * worst, 9), -np.inf)
                    i = int(s.argmax())
                    out.append((rank, names[i], float(v[i])))
                    left[i] = False
                    worst = np.maximum(worst, phi[i])
                yield pd.DataFrame(out, columns=["rank", "term", "value"])

    return t.join(ab, "one", "left").select("terms", "pairs").mapInPandas(choose, "rank int, term string, value double")


def signature_pools(post: DataFrame, key: str, min_pairs: int) -> DataFrame:
    """(term, family, pooled_df): words that share a stem of four letters or more and differ by a pair of
    endings seen on at least ``min_pairs`` stems form families; pooled_df counts documents with any of them."""
    from sectloom.operators.graph import components

    t = post.select("term").distinct().filter(F.col("term").rlike("^[a-z]{4,}$"))
    x = t.select("term", F.explode(F.sequence(F.greatest(F.lit(4), F.length("term") - 4), F.length("term"))).alias("i")).select("term", F.expr("substring(term, 1, i)").alias("stem"), F.expr("substring(term, i + 1)").alias("end"))
    j = x.select("stem", F.col("term").alias("a"), F.col("end").alias("ea")).join(x.select("stem", F.col("term").alias("b"), F.col("end").alias("eb")), "stem").filter("ea < eb")
    good = j.groupBy("ea", "eb").agg(F.countDistinct("stem").alias("n")).filter(F.col("n") >= min_pairs).filter("length(ea) <= 3 AND length(eb) <= 3")
    edges = cut(j.join(good, ["ea", "eb"]).select("a", "b").distinct(), "edges")
    fam = components(edges, t.withColumnRenamed("term", "id"))
    pooled = post.select(key, "term").join(fam.select(F.col("id").alias("term"), F.col("component").alias("family")), "term")
    df = pooled.groupBy("family").agg(F.countDistinct(key).alias("pooled_df"))
    return fam.select(F.col("id").alias("term"), F.col("component").alias("family")).join(df, "family").select("term", "family", "pooled_df")


def rank_sum_terms(w: DataFrame, members: DataFrame, gate: DataFrame, k: int = 10) -> DataFrame:
    """(cid, term, auc, rank): for gated terms, the chance that a member section outweighs another one (ties
    half); sections without the term weigh 0."""
    g = w.join(gate, "term").join(members.withColumnRenamed("cid", "own"), "record_id").withColumn("inside", (F.col("own") == F.col("cid")).cast("int"))
    g = g.withColumn("w", F.round("w", 6))
    win = Window.partitionBy("cid", "term").orderBy("w").rowsBetween(Window.unboundedPreceding, -1)
    vals = g.groupBy("cid", "term", "w").agg(F.sum("inside").alias("i"), F.sum(1 - F.col("inside")).alias("o"))
    vals = vals.withColumn("below", F.coalesce(F.sum("o").over(win), F.lit(0)))
    size = members.groupBy("cid").agg(F.count(F.lit(1)).alias("size"))
    n = members.count()
    s = vals.groupBy("cid", "term").agg(F.sum(F.col("i") * (F.col("below") + F.col("o") / 2)).alias("u"), F.sum("i").alias("ni"), F.sum("o").alias("no")).join(size, "cid")
    zo = F.lit(n) - F.col("size") - F.col("no")
    u = F.col("u") + F.col("ni") * zo + (F.col("size") - F.col("ni")) * zo / 2
    r = s.withColumn("auc", F.round(u / (F.col("size") * (F.lit(n) - F.col("size"))), 6))
    return lexical.top(r.select("cid", "term", "auc"), ["cid"], [F.col("auc").desc(), F.col("term")], k)


def correlation_chains(m: DataFrame, top: int) -> DataFrame:
    """(build_id, chain, step, entity_id, r): the ``top`` most frequent entities of a build in chains: each
    follows the one its log counts correlate with most, if the correlation is significant."""
    f = m.groupBy("build_id", "entity_id").agg(F.count(F.lit(1)).alias("df"))
    best = lexical.top(f, ["build_id"], [F.col("df").desc(), F.col("entity_id")], top).select("build_id", "entity_id")
    x = m.join(best, ["build_id", "entity_id"]).withColumn("x", F.log1p(F.col("cnt").cast("double")))
    n = m.groupBy("build_id").agg(F.countDistinct("ord").alias("n"))
    s = x.groupBy("build_id", "entity_id").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    a, b = x.select("build_id", "ord", F.col("entity_id").alias("a"), F.col("x").alias("xa")), x.select("build_id", "ord", F.col("entity_id").alias("b"), F.col("x").alias("xb"))
    p = a.join(b, ["build_id", "ord"]).filter("a < b").groupBy("build_id", "a", "b").agg(F.sum(F.col("xa") * F.col("xb")).alias("ab"))
    j = p.join(s.select("build_id", F.col("entity_id").alias("a"), F.col("s").alias("sa"), F.col("q").alias("qa")), ["build_id", "a"]).join(s.select("build_id", F.col("entity_id").alias("b"), F.col("s").alias("sb"), F.col("q").alias("qb")), ["build_id", "b"]).join(n, "build_id")
    r = (F.col("n") * F.col("ab") - F.col("sa") * F.col("sb")) / F.sqrt((F.col("n") * F.col("qa") - F.col("sa") * F.col("sa")) * (F.col("n") * F.col("qb") - F.col("sb") * F.col("sb")))

    def chains(pdf: pd.DataFrame) -> pd.DataFrame:
        build, n = int(pdf.build_id.iloc[0]), float(pdf.n.iloc[0])
        ok = []
        for a, b, r in zip(pdf.a, pdf.b, pdf.r):
            t = r * np.sqrt(max(n - 2, 1) / max(1e-12, 1 - r * r))
            if r > 0 and stats.t_sf(t, max(n - 2, 1)) < 0.01:
                ok.append((-round(r, 9), int(a), int(b)))
        end: dict[int, list[int]] = {}
        links: dict[int, list[tuple[int, float]]] = {}
        group: dict[int, int] = {}

        def root(v):
            while group.get(v, v) != v:
                v = group[v]
            return v

        for r, a, b in sorted(ok):
            if len(links.get(a, [])) < 2 and len(links.get(b, [])) < 2 and root(a) != root(b):
                links.setdefault(a, []).append((b, -r))
                links.setdefault(b, []).append((a, -r))
                group[root(a)] = root(b)
        out, seen, chain = [], set(), 0
        for v in sorted(links, key=lambda v: (len(links[v]), v)):
            if v in seen or len(links[v]) != 1:
                continue
            step, cur, prev, r = 0, v, None, 0.0
            while cur is not None:
                out.append((build, chain, step, cur, r))
                seen.add(cur)
                nxt = [(u, q) for u, q in links[cur] if u != prev]
                prev, (cur, r) = cur, nxt[0] if nxt else (None, 0.0)
                step += 1
            chain += 1
        return pd.DataFrame(out, columns=["build_id", "chain", "step", "entity_id", "r"])

    return j.select("build_id", "a", "b", "n", r.alias("r")).groupBy("build_id").applyInPandas(chains, "build_id long, chain int, step int, entity_id int, r double")
