"""Graph loops and walks over edge tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sectloom.plans.runtime import cut, release


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, component): connected components by least id: every node takes the least label among its
    neighbours and then its label's own label, until nothing moves. ``edges`` has (a, b) once each."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    lab = cut(nodes.select("id", F.col("id").alias("component")).distinct(), "labels")
    while True:
        low = both.join(lab, both.b == lab.id).groupBy("a").agg(F.min("component").alias("low"))
        step = lab.join(low, lab.id == low.a, "left").select("id", "component", F.least("component", F.coalesce("low", "component")).alias("c"))
        jump = lab.select(F.col("id").alias("c"), F.col("component").alias("cc"))
        new = cut(step.join(jump, "c", "left").select("id", F.least("c", F.coalesce("cc", "c")).alias("component"), (F.col("c") < F.col("component")).alias("moved")), "labels")
        moved = new.filter("moved").limit(1).count()
        release(lab)
        lab = new
        if not moved:
            return lab.select("id", "component")


def pagerank(sym: DataFrame, alpha: float = 0.85, rounds: int = 20, restart: DataFrame | None = None) -> DataFrame:
    """(build_id, id, rank) after ``rounds`` of weighted PageRank per build. ``restart`` (build_id, id, p) makes
    it personalised; dangling mass and restarts go there, else evenly."""
    deg = sym.groupBy("build_id", F.col("a").alias("id")).agg(F.sum("s").alias("d"))
    n = deg.groupBy("build_id").agg(F.count(F.lit(1)).alias("n"))
    if restart is None:
        base = deg.join(n, "build_id").select("build_id", "id", (1 / F.col("n")).alias("p"))
    else:
        base = deg.select("build_id", "id").join(restart, ["build_id", "id"], "left").fillna(0.0, ["p"])
    base = cut(base, "base")
    share = cut(sym.join(deg.select("build_id", F.col("id").alias("a"), "d"), ["build_id", "a"]).select("build_id", "a", "b", (F.col("s") / F.col("d")).alias("w")), "share")
    r = base.select("build_id", "id", F.col("p").alias("rank"))
    for i in range(rounds):
        got = share.join(r.select("build_id", F.col("id").alias("a"), "rank"), ["build_id", "a"]).groupBy("build_id", F.col("b").alias("id")).agg(F.sum(F.col("rank") * F.col("w")).alias("g"))
        r = base.join(got, ["build_id", "id"], "left").select("build_id", "id", ((1 - alpha) * F.col("p") + alpha * F.coalesce("g", F.lit(0.0))).alias("rank"))
        if i % 5 == 4:
            r = cut(r, "rank")
    return r


def expand_paths(sym: DataFrame, seeds: DataFrame, hops: int, min_score: float) -> DataFrame:
    """(build_id, seed, node, score, hop, path): simple paths from each seed with multiplied strengths above ``min_score``."""
    cur = seeds.select("build_id", "seed", F.col("seed").alias("node"), F.lit(1.0).alias("score"), F.array("seed").alias("path"))
    out = None
    e = sym.select("build_id", F.col("a").alias("node"), F.col("b").alias("next"), "s")
    for h in range(1, hops + 1):
        cur = cur.join(e, ["build_id", "node"]).filter(~F.array_contains("path", F.col("next"))).select("build_id", "seed", F.col("next").alias("node"), (F.col("score") * F.col("s")).alias("score"), F.concat("path", F.array("next")).alias("path")).filter(F.col("score") > min_score)
        cur = cut(cur, "hop")
        step = cur.withColumn("hop", F.lit(h))
        out = step if out is None else out.unionByName(step)
    return out


def best_reach(paths: DataFrame) -> DataFrame:
    """The best path to each node of each seed: largest score, then fewest hops, then least path."""
    w = Window.partitionBy("build_id", "seed", "node").orderBy(F.round("score", 9).desc(), "hop", "path")
    return paths.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def cheapest_paths(sym: DataFrame, seeds: DataFrame, damp: float) -> DataFrame:
    """(build_id, seed, node, cost): least cost of -ln(strength) plus ``damp`` ln(degree) of inner nodes, by
    rounds of relaxation until nothing improves."""
    deg = sym.groupBy("build_id", F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("deg"))
    e = cut(sym.select("build_id", F.col("a").alias("node"), F.col("b").alias("next"), (-F.log(F.least("s", F.lit(1.0)))).alias("c")).join(deg, ["build_id", "node"]), "costs")
    best = cut(seeds.select("build_id", "seed", F.col("seed").alias("node"), F.lit(0.0).alias("cost")), "best")
    front = best
    while True:  # costs only fall, and paths that grow by no cost are not taken again
        inner = F.when(F.col("node") == F.col("seed"), 0.0).otherwise(damp * F.log("deg"))
        cand = front.join(e, ["build_id", "node"]).groupBy("build_id", "seed", F.col("next").alias("node")).agg(F.min(F.col("cost") + F.col("c") + inner).alias("new"))
        j = cut(best.join(cand, ["build_id", "seed", "node"], "full_outer").select("build_id", "seed", "node", "cost", "new"), "relaxed")
        front = cut(j.filter("cost IS NULL OR new < cost - 1e-12").select("build_id", "seed", "node", F.col("new").alias("cost")), "front")
        nxt = cut(j.select("build_id", "seed", "node", F.least(F.coalesce("cost", "new"), F.coalesce("new", "cost")).alias("cost")), "best")
        release(best)
        best = nxt
        if not front.limit(1).count():
            break
    return best


def triangles(e: DataFrame) -> DataFrame:
    """(build_id, id, triangles) from canonical edges; each edge is led by its end of lesser degree, so a hub opens few pairs."""
    both = e.select("build_id", "a", "b").unionByName(e.select("build_id", F.col("b").alias("a"), F.col("a").alias("b")))
    deg = both.groupBy("build_id", "a").agg(F.count(F.lit(1)).alias("d"))
    j = e.join(deg.withColumnRenamed("d", "da"), ["build_id", "a"]).join(deg.select("build_id", F.col("a").alias("b"), F.col("d").alias("db")), ["build_id", "b"])
    low = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    o = j.select("build_id", F.when(low, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("v"))
    wedge = o.alias("x").join(o.alias("y"), (F.col("x.build_id") == F.col("y.build_id")) & (F.col("x.u") == F.col("y.u")) & (F.col("x.v") < F.col("y.v"))).select(F.col("x.build_id").alias("build_id"), F.col("x.u").alias("u"), F.col("x.v").alias("a"), F.col("y.v").alias("b"))
    t = wedge.join(e.select("build_id", "a", "b"), ["build_id", "a", "b"])
    return t.select("build_id", F.explode(F.array("u", "a", "b")).alias("id")).groupBy("build_id", "id").agg(F.count(F.lit(1)).alias("triangles"))


def betweenness(sym: DataFrame, sources: DataFrame) -> DataFrame:
    """(build_id, id, score): shortest-path betweenness from the given sources (build_id, src); every source is a
    task row of its own over its build's adjacency, which is shipped once a build."""
    adj = sym.groupBy("build_id", "a").agg(F.sort_array(F.collect_list("b")).alias("nb")).groupBy("build_id").agg(F.collect_list(F.struct("a", "nb")).alias("adj"))
    j = sources.repartition(16, "build_id", "src").join(adj, "build_id")

    def brandes(it):
        for pdf in it:
            out = []
            for build, src, rows in zip(pdf.build_id, pdf.src, pdf.adj):
                nb = {r["a"]: list(r["nb"]) for r in rows}
                order, pred, sigma, dist = [], {src: []}, {src: 1.0}, {src: 0}
                queue = [src]
                for v in queue:
                    order.append(v)
                    for w in nb.get(v, []):
                        if w not in dist:
                            dist[w], sigma[w], pred[w] = dist[v] + 1, 0.0, []
                            queue.append(w)
                        if dist[w] == dist[v] + 1:
                            sigma[w] += sigma[v]
                            pred[w].append(v)
                delta = dict.fromkeys(order, 0.0)
                for w in reversed(order):
                    for v in pred[w]:
                        delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
                    if w != src:
                        out.append((build, w, delta[w]))
            yield pd.DataFrame(out, columns=["build_id", "id", "score"])

    return j.mapInPandas(brandes, "build_id long, id int, score double").groupBy("build_id", "id").agg(F.sum("score").alias("score"))


def louvain_labels(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, resolution: float = 1.0, passes: int = 30, seed: int = 0) -> np.ndarray:
    """Communities of a graph by local moving and merging; nodes in order of number, or shuffled by a ``seed`` above 0; ties
    to the least community."""
    if seed:
        order = np.random.default_rng(seed).permutation(n)
        return louvain_labels(n, order[src], order[dst], w, resolution, passes)[order]
    lab = np.arange(n)
    cur_src, cur_dst, cur_w, size = src, dst, w, n
    total = 2.0 * w.sum()
    if total <= 0:
        return lab
    while True:
        order = np.argsort(np.concatenate([cur_src, cur_dst]), kind="stable")
        a, b = np.concatenate([cur_src, cur_dst])[order], np.concatenate([cur_dst, cur_src])[order]
        ww = np.concatenate([cur_w, cur_w])[order]
        start = np.searchsorted(a, np.arange(size + 1))
        k = np.bincount(a, ww, size)
        com, tot = np.arange(size), k.copy()
        moved_any = False
        for _ in range(passes):
            moved = False
            for v in range(size):
                lo, hi = start[v], start[v + 1]
                other = b[lo:hi] != v
                if not other.any():
                    continue
                cs, inv = np.unique(com[b[lo:hi][other]], return_inverse=True)
                kin = np.bincount(inv, ww[lo:hi][other])
                own = com[v]
                tot[own] -= k[v]
                gain = kin - resolution * tot[cs] * k[v] / total
                at = np.searchsorted(cs, own)
                stay = gain[at] if at < len(cs) and cs[at] == own else -resolution * tot[own] * k[v] / total
                i = int(gain.argmax())
                new = int(cs[i]) if gain[i] > stay + 1e-12 else own
                tot[new] += k[v]
                if new != own:
                    com[v] = new
                    moved = moved_any = True
            if not moved:
                break
        if not moved_any:
            return lab
        _, com = np.unique(com, return_inverse=True)
        lab = com[lab]
        size = int(com.max()) + 1
        key = np.minimum(com[cur_src], com[cur_dst]) * size + np.maximum(com[cur_src], com[cur_dst])
        u, inv = np.unique(key, return_inverse=True)
        cur_w = np.bincount(inv, cur_w)
        cur_src, cur_dst = u // size, u % size


def louvain(edges: DataFrame, by: list[str], resolution: float = 1.0) -> DataFrame:
    """(by, id, cid): communities of each group's graph (a, b, s), one task a group; numbered by their least member. Columns
    ``resolution`` and ``seed`` of the edges hold for their group."""
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, inv = np.unique(np.concatenate([pdf.a.values, pdf.b.values]), return_inverse=True)
        m = len(pdf)
        lab = louvain_labels(len(ids), inv[:m], inv[m:], pdf.s.values.astype(float), float(pdf["resolution"].iloc[0]) if "resolution" in pdf else resolution, seed=int(pdf["seed"].iloc[0]) if "seed" in pdf else 0)
        least = np.full(lab.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, lab, ids)
        return pd.DataFrame({**{c: pdf[c].iloc[0] for c in by}, "id": ids, "cid": least[lab]})

    kinds = ", ".join(f"{c} {edges.schema[c].dataType.simpleString()}" for c in by)
    return edges.groupBy(*by).applyInPandas(work, f"{kinds}, id long, cid long")


def consensus(edges: DataFrame, by: list[str], seeds: list[int]) -> DataFrame:
    """(by, id, cid): communities of the edges whose ends are together for at least half of the seeds, weighted by that share;
    nodes that no such edge joins are communities of their own. ``by`` may hold the resolution."""
    base = edges.select(*by, "a", "b", "s")
    runs = cut(louvain(base.withColumn("seed", F.explode(F.array(*[F.lit(x) for x in seeds]))), [*by, "seed"]), "runs")
    end = lambda c: runs.select(*by, "seed", F.col("id").alias(c), F.col("cid").alias(f"c{c}"))
    j = base.join(end("a"), [*by, "a"]).join(end("b"), [*by, "seed", "b"])
    kept = j.groupBy(*by, "a", "b").agg(F.avg((F.col("ca") == F.col("cb")).cast("double")).alias("s")).filter("s >= 0.5")
    got = cut(louvain(kept, by), "consensus")
    alone = runs.select(*by, "id").distinct().join(got.select(*by, "id"), [*by, "id"], "left_anti")
    return got.unionByName(alone.select(*by, "id", F.col("id").alias("cid")))


def seed_agreement(edges: DataFrame, by: list[str], resolutions: list[float], seeds: list[int]) -> DataFrame:
    """(by, resolution, communities, ari): mean number of communities over seeds at each resolution, and the mean adjusted Rand
    index of all pairs of seeds."""
    e = edges.select(*by, "a", "b", "s", F.explode(F.array(*[F.lit(float(r)) for r in resolutions])).alias("resolution")).withColumn("seed", F.explode(F.array(*[F.lit(x) for x in seeds])))
    at = [*by, "resolution"]
    m = cut(louvain(e, [*at, "seed"]), "sweep")
    y = m.select(*at, "id", F.col("seed").alias("seed2"), F.col("cid").alias("cid2"))
    pairs = m.join(y, [*at, "id"]).filter("seed < seed2")  # as many rows a node as there are pairs of seeds
    ari = adjusted_rand(pairs, "cid", "cid2", [*at, "seed", "seed2"]).groupBy(*at).agg(F.avg("ari").alias("ari"))
    return m.groupBy(*at, "seed").agg(F.countDistinct("cid").alias("n")).groupBy(*at).agg(F.avg("n").alias("communities")).join(ari, at)


def plateau(sweep: list[tuple[float, float, float]], target: float) -> float:
    """The resolution of a sweep (resolution, communities, agreement) to serve: of the longest run of resolutions whose agreement
    stays within 1.4826 median deviations of its successive differences (ties: the higher mean agreement), the one whose
    number of communities is nearest ``target`` (ties: the lower resolution)."""
    x = sorted(sweep)
    a = np.array([r[2] for r in x])
    step = np.diff(a)
    jitter = 1.4826 * float(np.median(np.abs(step - np.median(step)))) if len(step) else 0.0
    runs = [(i, j) for i in range(len(x)) for j in range(i, len(x)) if np.ptp(a[i : j + 1]) <= jitter or i == j]
    i, j = max(runs, key=lambda r: (r[1] - r[0], a[r[0] : r[1] + 1].mean(), -r[0]))
    return min(x[i : j + 1], key=lambda r: (abs(r[1] - target), r[0]))[0]


def split_oversize(edges: DataFrame, members: DataFrame, by: list[str], gate: float = 0.8, levels: int = 3) -> DataFrame:
    """(by, id, cid, coarse): communities of more members than the root of their graph's number of edges are divided inside their own
    induced graph, up to ``levels`` times: consensus over seeds at twice the resolution, kept only if three consensus runs
    agree to ``gate``; ``coarse`` is the label before. Parts are named by their least member."""
    bound = edges.groupBy(*by).agg(F.sqrt(F.count(F.lit(1))).alias("bound"))
    cur = cut(members.select(*by, "id", "cid", F.col("cid").alias("coarse")), "members")
    for level in range(levels):
        size = cur.groupBy(*by, "cid").agg(F.count(F.lit(1)).alias("n")).join(bound, by)
        big = cut(size.filter("n > bound").select(*by, "cid"), "big")
        if not big.limit(1).count():
            break
        inside = cur.join(big, [*by, "cid"], "left_semi")
        end = lambda c: inside.select(*by, F.col("id").alias(c), F.col("cid").alias(f"c{c}"))
        sub = edges.join(end("a"), [*by, "a"]).join(end("b"), [*by, "b"]).filter("ca = cb").select(*by, F.col("ca").alias("part"), "a", "b", "s", F.lit(2.0 ** (level + 1)).alias("resolution"))
        sub = cut(sub, "inside")
        at = [*by, "part", "resolution"]
        runs = None
        for k in range(3):
            c = consensus(sub, at, [10 * k + i + 1 for i in range(3)]).withColumn("run", F.lit(k))
            runs = c if runs is None else runs.unionByName(c)
        runs = cut(runs, "runs")
        y = runs.select(*at, "id", F.col("run").alias("run2"), F.col("cid").alias("cid2"))
        agree = adjusted_rand(runs.join(y, [*at, "id"]).filter("run < run2"), "cid", "cid2", [*at, "run", "run2"]).groupBy(*at).agg(F.avg("ari").alias("ari"))
        ok = agree.filter(F.col("ari") >= gate).select(*by, "part")
        new = runs.filter("run = 0").join(ok, [*by, "part"], "left_semi").select(*by, "id", F.col("cid").alias("new"))
        nxt = cut(cur.join(new, [*by, "id"], "left").select(*by, "id", F.coalesce("new", "cid").alias("cid"), "coarse"), "members")
        moved = nxt.join(cur.select(*by, "id", F.col("cid").alias("was")), [*by, "id"]).filter("cid <> was").limit(1).count()
        cur = nxt
        if not moved:
            break
    return cur


def modularity(e: DataFrame, member: DataFrame) -> DataFrame:
    """(build_id, q): weighted modularity of a partition (build_id, id, cid)."""
    x = e.join(member.select("build_id", F.col("id").alias("a"), F.col("cid").alias("ca")), ["build_id", "a"]).join(member.select("build_id", F.col("id").alias("b"), F.col("cid").alias("cb")), ["build_id", "b"])
    tot = x.groupBy("build_id").agg(F.sum("s").alias("m"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("s")).otherwise(0.0)).alias("inside"))
    d = x.select("build_id", F.explode(F.array(F.struct(F.col("ca").alias("c"), "s"), F.struct(F.col("cb").alias("c"), "s"))).alias("z")).groupBy("build_id", "z.c").agg(F.sum("z.s").alias("k"))
    sq = d.join(tot, "build_id").groupBy("build_id").agg(F.sum(F.pow(F.col("k") / (2 * F.col("m")), 2)).alias("e2"))
    return tot.join(sq, "build_id").select("build_id", (F.col("inside") / F.col("m") - F.col("e2")).alias("q"))


def adjusted_rand(x: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """(by, ari) of two labellings of the same rows, from their contingency counts."""
    pairs = lambda c: c * (c - 1) / 2
    n = F.col("n").cast("double")
    ab = x.groupBy(*by, a, b).agg(F.count(F.lit(1)).alias("n")).groupBy(*by).agg(F.sum(pairs(n)).alias("ij"))
    ra = x.groupBy(*by, a).agg(F.count(F.lit(1)).alias("n")).groupBy(*by).agg(F.sum(pairs(n)).alias("i"), F.sum("n").alias("tot"))
    rb = x.groupBy(*by, b).agg(F.count(F.lit(1)).alias("n")).groupBy(*by).agg(F.sum(pairs(n)).alias("j"))
    j = ab.join(ra, by).join(rb, by)
    exp = F.col("i") * F.col("j") / pairs(F.col("tot").cast("double"))
    top = (F.col("i") + F.col("j")) / 2
    return j.select(*by, F.when(top == exp, 1.0).otherwise((F.col("ij") - exp) / (top - exp)).alias("ari"))


def beam_walk(sym: DataFrame, seeds: DataFrame, ef: int, max_hops: int) -> DataFrame:
    """(build_id, seed, node, score, hop): best-first search from each seed that keeps the ``ef`` best nodes and
    stops when the best open one is worse than the worst kept. Each seed's bounded neighbourhood (paths of up to
    ``max_hops``) is gathered by joins first; the walk itself is one row."""
    near = cut(seeds.select("build_id", "seed", F.col("seed").alias("node")), "near")
    e = sym.select("build_id", F.col("a").alias("node"), F.col("b").alias("next"), "s")
    seen = near
    for _ in range(max_hops):
        nxt = near.join(e, ["build_id", "node"]).select("build_id", "seed", F.col("next").alias("node")).distinct()
        near = cut(nxt.join(seen, ["build_id", "seed", "node"], "left_anti"), "near")
        seen = cut(seen.unionByName(near), "seen")
    local = seen.join(e, ["build_id", "node"]).groupBy("build_id", "seed").agg(F.collect_list(F.struct("node", "next", "s")).alias("adj"))

    def walk(it):
        import heapq

        for pdf in it:
            out = []
            for build, seed, rows in zip(pdf.build_id, pdf.seed, pdf.adj):
                nb: dict[int, list[tuple[int, float]]] = {}
                for r in rows:
                    nb.setdefault(r["node"], []).append((r["next"], r["s"]))
                best, hop = {seed: 1.0}, {seed: 0}
                open_, kept = [(-1.0, seed)], [(1.0, -seed)]
                while open_:
                    d, v = heapq.heappop(open_)
                    if len(kept) >= ef and -d < kept[0][0]:
                        break
                    if hop[v] >= max_hops:
                        continue
                    for u, s in sorted(nb.get(v, [])):
                        g = -d * s
                        if u in best or (len(kept) >= ef and g <= kept[0][0]):
                            continue
                        best[u], hop[u] = g, hop[v] + 1
                        heapq.heappush(open_, (-g, u))
                        heapq.heappush(kept, (g, -u))
                        if len(kept) > ef:
                            heapq.heappop(kept)
                out += [(build, seed, -u, g, hop[-u]) for g, u in kept]
            yield pd.DataFrame(out, columns=["build_id", "seed", "node", "score", "hop"])

    return local.mapInPandas(walk, "build_id long, seed int, node int, score double, hop int")


def gumbel_sample(df: DataFrame, by: list[str], key: str, score: str, temperature: float, k: int, seed: str) -> DataFrame:
    """k rows of each group drawn without replacement with chances by exp(score / temperature), from hashed
    uniforms; at temperature 0 the k best (a sampling operator)."""
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *by, key)), 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)
    v = F.col(score) if temperature == 0 else F.col(score) / temperature - F.log(-F.log(u))
    w = Window.partitionBy(*by).orderBy(F.round(v, 9).desc(), key)
    return df.withColumn("draw", F.row_number().over(w)).filter(F.col("draw") <= k)


def mutual_reach(n: int) -> float:
    """Largest entropy of n equal shares, in bits."""
    return math.log2(n) if n > 0 else 0.0
