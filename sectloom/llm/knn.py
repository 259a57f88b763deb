"""Most similar vectors for every vector: NN-descent in Spark joins, and greedy search in the graph."""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sectloom.llm.vectors import matrix, usable
from sectloom.plans.runtime import cut, forget, release, size_bound

#: Neighbours kept while the graph is built, trees it begins from, and rows of one leaf.
KEEP, TREES, LEAF = 12, 3, 4096
#: Rows the trees' split directions are fitted on, and rows a leaf that came out larger than twice LEAF is split
#: further on; every row is then routed and searched.
SAMPLE, AGAIN = 20_000, 2048
#: Rows of one leaf that are routed together when it is split further; numbers a split leaf's parts get.
ROUTED, PARTS = 20_000, 4096
#: A round of neighbours of neighbours that changes at most this share of the lists' entries is the last.
SETTLED = 0.002
#: Neighbours of each direction whose pairs a round compares.
JOIN = 8
#: Pairs of a round whose rows are looked up by broadcasting their ids (twice as many at most); more are joined.
FEW = 500_000
#: Neighbouring leaves of the first tree whose rows' pairs are compared in one task.
NEAR = 4
#: Copies of one vector that stand for all of them in a list; must exceed the k asked for.
COPIES = 16


class Forest:
    """Trees of two-means splits over a bounded sample; leaves are expected to hold at most ``leaf`` rows of all. Leaves
    are numbered from left to right."""

    def __init__(self, sample: np.ndarray, rows: int, trees: int, leaf: int):
        self.trees = [self._grow(sample, rows / max(1, len(sample)), leaf, np.random.default_rng(t)) for t in range(trees)]

    @staticmethod
    def _grow(x: np.ndarray, scale: float, leaf: int, rng) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        dirs, cuts, kids = [], [], []

        def node(idx: np.ndarray) -> int:
            """Number of the node, or -1 - leaf."""
            nonlocal leaves
            if len(idx) * scale <= leaf or len(idx) < 8:
                leaves += 1
                return -leaves
            y = x[idx]
            a, b = y[rng.choice(len(y), 2, replace=False)]
            if (a == b).all():  # copies: draw again among the others
                others = np.flatnonzero((y != a).any(1))
                if len(others):
                    b = y[rng.choice(others)]
            for _ in range(8):
                left = y @ (a - b) > (a @ a - b @ b) / 2
                if left.all() or not left.any():
                    break
                a, b = y[left].mean(0), y[~left].mean(0)
            p = y @ (a - b)
            at = float((a @ a - b @ b) / 2)
            share = (p > at).mean()
            if not 0.1 <= share <= 0.9:
                at = float(np.median(p))
            left = p > at
            if left.all() or not left.any():  # most lie at the median
                at = (float(p.min()) + float(p.max())) / 2
                left = p > at
            if left.all() or not left.any():  # all alike: no split helps
                leaves += 1
                return -leaves
            me = len(dirs)
            dirs.append(a - b)
            cuts.append(at)
            kids.append([0, 0])
            kids[me][0] = node(idx[left])
            kids[me][1] = node(idx[~left])
            return me

        leaves = 0
        root = node(np.arange(len(x)))
        d = x.shape[1]
        return (np.array(dirs, np.float32).reshape(-1, d), np.array(cuts, np.float32), np.array(kids, np.int32).reshape(-1, 2)) if root >= 0 else (np.empty((0, d), np.float32), np.empty(0, np.float32), np.empty((0, 2), np.int32))

    def route(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row in each tree."""
        out = np.zeros((len(x), len(self.trees)), np.int32)
        for t, (dirs, cuts, kids) in enumerate(self.trees):
            if not len(dirs):
                continue
            at = np.zeros(len(x), np.int32)
            live = np.arange(len(x))
            while len(live):
                for n in np.unique(at[live]):
                    rows = live[at[live] == n]
                    left = x[rows] @ dirs[n] > cuts[n]
                    at[rows] = np.where(left, kids[n][0], kids[n][1])
                live = live[at[live] >= 0]
            out[:, t] = -at - 1
        return out


def pack(x: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Unit vectors as bytes of eighths of precision: 8 bits a number, and the scale of each row."""
    s = np.abs(x).max(1) / 127.0
    q = np.rint(x / s[:, None]).astype(np.int8)
    return [r.tobytes() for r in q], s.astype(np.float32)


def unpack(code: pd.Series, scale: pd.Series, dim: int) -> np.ndarray:
    q = np.frombuffer(b"".join(code.values), np.int8).reshape(-1, dim).astype(np.float32)
    q *= scale.values[:, None]
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    return q


def best_of(ids: np.ndarray, sims: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of each row of ``sims``, unordered."""
    return np.argpartition(sims, -k, axis=1)[:, -k:] if sims.shape[1] > k else np.tile(np.arange(sims.shape[1]), (len(sims), 1))


def best_lists(pairs: DataFrame, k: int) -> DataFrame:
    """The same for pairs that may be repeated, of which no a has very many: moved once, by a, for both steps."""
    return top_lists(pairs.repartition("a").groupBy("a", "b").agg(F.max("s").alias("s")), k)


def top_lists(pairs: DataFrame, k: int) -> DataFrame:
    """(a, b, s): the k most similar b of each a; ties: the lesser b. The limit acts before the shuffle,
    so an a with very many partners is cut down in every task."""
    w = Window.partitionBy("a").orderBy(F.col("s").desc(), "b")
    return pairs.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def encode(df: DataFrame, key: str, vec: str, dim: int, trees: int, leaf: int, sample: int = SAMPLE) -> tuple[DataFrame, DataFrame | None]:
    """(id, code, scale, leaves): distinct packed vectors routed to their leaf of every tree; and (rep, id) of
    the copies, see :func:`collapse`. The trees are fitted on distinct vectors; no leaf has more than twice
    ``leaf`` rows."""
    u = usable(df, key, vec, dim).select(F.col(key).cast("long").alias("id"), F.col(vec).alias("v"))

    def packed(it):
        for pdf in it:
            if len(pdf):
                code, scale = pack(matrix(pdf.v, dim))
                yield pd.DataFrame({"id": pdf.id, "code": code, "scale": scale})

    whole = cut(u.mapInPandas(packed, "id long, code binary, scale float"), "packed")
    reps, members = collapse(whole)
    if members is not None:
        release(whole)
    n = reps.count()
    share = min(1.0, 1.3 * sample / max(1, n))
    # a sample by a hash of the key, so that it doesn't depend on how rows lie in partitions
    picked = reps.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000)).limit(sample).toPandas()
    forest = Forest(unpack(picked.code, picked.scale, dim) if len(picked) else np.empty((0, dim), np.float32), n, trees, leaf)

    def work(it):
        for pdf in it:
            if len(pdf):
                yield pdf.assign(leaves=list(forest.route(unpack(pdf.code, pdf.scale, dim)).astype(np.int64)))

    codes = cut(reps.mapInPandas(work, "id long, code binary, scale float, leaves array<long>"), "codes")
    release(reps)
    return split_further(codes, dim, leaf), members


def split_further(codes: DataFrame, dim: int, leaf: int) -> DataFrame:
    """The same codes with every leaf of more than twice ``leaf`` rows split by a tree of its own, fitted on AGAIN of
    its rows, again and again until none is larger. Rows of one leaf are routed in groups of about ROUTED,
    so neither a leaf nor its tree need fit a task whole. Distinct vectors can always be told apart, so the
    rounds end."""
    while True:
        size = codes.select(F.explode(F.transform("leaves", lambda v, t: F.struct(t.alias("t"), v.alias("leaf")))).alias("z")).groupBy("z.t", "z.leaf").agg(F.count(F.lit(1)).alias("n"))
        big = cut(size.filter(F.col("n") > 2 * leaf), "big")
        if not big.limit(1).count():
            release(big)
            return codes
        rows = codes.select("id", "code", "scale", F.posexplode("leaves").alias("t", "leaf")).join(big, ["t", "leaf"])
        chance = F.pmod(F.xxhash64("id", "t"), F.lit(1_000_000)) < F.col("_share")
        some = rows.withColumn("_share", F.least(F.lit(1.0), 1.3 * AGAIN / F.col("n")) * 1_000_000).filter(chance)

        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("id").head(AGAIN)
            f = Forest(unpack(pdf.code, pdf.scale, dim), int(pdf.n.iloc[0]), 1, leaf)
            return pd.DataFrame({"t": [pdf.t.iloc[0]], "leaf": [pdf.leaf.iloc[0]], "n": [pdf.n.iloc[0]], "tree": [pickle.dumps(f)]})

        trees = cut(some.groupBy("t", "leaf").applyInPandas(fit, "t int, leaf long, n long, tree binary"), "trees")
        salts = F.ceil(F.col("n") / ROUTED).cast("int")
        each = trees.select("t", "leaf", "tree", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))

        def route(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({"id": [], "t": [], "to": []})
            at = pickle.loads(right.tree.iloc[0]).route(unpack(left.code, left.scale, dim))[:, 0].astype(np.int64)
            return pd.DataFrame({"id": left.id, "t": left.t, "to": (left.leaf + 1) * PARTS + at})

        salted = rows.withColumn("salt", F.pmod(F.hash("id"), salts))
        moved = salted.groupBy("t", "leaf", "salt").cogroup(each.groupBy("t", "leaf", "salt")).applyInPandas(route, "id long, t int, to long")
        by = moved.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("t", "to"))).alias("_to"))  # at most a tree each
        new = codes.join(by, "id", "left").withColumn("leaves", F.when(F.col("_to").isNull(), F.col("leaves")).otherwise(F.transform("leaves", lambda v, t: F.coalesce(F.element_at("_to", t), v)))).drop("_to")
        new = cut(new, "codes")
        for gone in (codes, big, trees):
            release(gone)
        codes = new


def leaf_graph(codes: DataFrame, dim: int, keep: int) -> DataFrame:
    """(a, b, s): the ``keep`` most similar rows of each row within its leaves: where NN-descent begins."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids = unpack(pdf.code, pdf.scale, dim), pdf.id.values
        out = []
        for lo in range(0, len(x), 512):
            s = x[lo : lo + 512] @ x.T
            s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -2.0
            c = best_of(ids, s, min(keep, len(x)))
            v = np.take_along_axis(s, c, 1)
            a = np.repeat(ids[lo : lo + 512], c.shape[1])
            out.append((a, ids[c].ravel(), v.ravel()))
        a, b, s = (np.concatenate(z) for z in zip(*out))
        ok = s > -1.5
        return pd.DataFrame({"a": a[ok], "b": b[ok], "s": s[ok]})

    x = codes.select("id", "code", "scale", F.posexplode("leaves").alias("t", "leaf"))
    return x.groupBy("t", "leaf").applyInPandas(work, "a long, b long, s float")


def links_of(graph: DataFrame) -> DataFrame:
    """(u, x): the nearest JOIN neighbours of each row in either direction."""
    near = Window.partitionBy("a").orderBy(F.col("s").desc(), "b")
    fwd = graph.withColumn("_r", F.row_number().over(near)).filter(F.col("_r") <= JOIN).select(F.col("a").alias("u"), F.col("b").alias("x"))
    back = Window.partitionBy("b").orderBy(F.col("s").desc(), "a")
    rev = graph.withColumn("_r", F.row_number().over(back)).filter(F.col("_r") <= JOIN).select(F.col("b").alias("u"), F.col("a").alias("x"))
    return fwd.unionByName(rev).distinct()


def round_pairs(links: DataFrame, before: DataFrame | None, codes: DataFrame) -> DataFrame:
    """(a, b): pairs of rows that share a neighbour and no leaf; a < b. Pairs of which both links stood in the
    links of the round before were compared then, and are left out."""
    if before is None:
        both = links.withColumn("old", F.lit(False))
    else:  # only rows that got a link have pairs to compare
        fresh = links.join(before, ["u", "x"], "left_anti").withColumn("new", F.lit(True))
        both = links.join(fresh.select("u").distinct(), "u", "left_semi").join(fresh, ["u", "x"], "left").select("u", "x", F.col("new").isNull().alias("old"))
    both = both.join(codes.select(F.col("id").alias("x"), "leaves"), "x")
    groups = both.groupBy("u").agg(F.collect_list(F.struct("x", "leaves", "old")).alias("m"))  # at most 2 * JOIN

    def work(it):
        for pdf in it:
            out = []
            for m in pdf.m:
                x = np.array([r["x"] for r in m], np.int64)
                l = np.array([r["leaves"] for r in m], np.int64)
                o = np.array([r["old"] for r in m], bool)
                i, j = np.triu_indices(len(x), 1)
                far = ~(l[i] == l[j]).any(1) & ~(o[i] & o[j])
                if far.any():
                    p, q = x[i[far]], x[j[far]]
                    out.append(np.stack([np.minimum(p, q), np.maximum(p, q)], 1))
            z = np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 2), np.int64)
            yield pd.DataFrame({"a": z[:, 0], "b": z[:, 1]})

    return groups.select("m").mapInPandas(work, "a long, b long").distinct()


def compare(pairs: DataFrame, codes: DataFrame, dim: int) -> DataFrame:
    """(a, b, s) both ways for pairs a < b. Pairs are grouped by the block of a, NEAR neighbouring leaves; each block
    gets every vector it needs once, so vectors are not sent once a pair. Leaves are bounded, so blocks are."""
    home = codes.select("id", F.floor(F.element_at("leaves", 1) / NEAR).alias("block"))
    p = pairs.join(home.select(F.col("id").alias("a"), "block"), "a")
    need = p.select("block", F.explode(F.array("a", "b")).alias("id")).distinct()
    if size_bound(pairs, FEW):
        need = F.broadcast(need)
    sent = codes.select("id", "code", "scale").join(need, "id").select(F.col("block").alias("to"), "id", "code", "scale")

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": [], "s": []})
        x = unpack(right.code, right.scale, dim)
        order = np.argsort(right.id.values)
        ids = right.id.values[order]
        i, j = order[np.searchsorted(ids, left.a.values)], order[np.searchsorted(ids, left.b.values)]
        s = np.concatenate([np.einsum("ij,ij->i", x[i[k : k + 20000]], x[j[k : k + 20000]]) for k in range(0, len(i), 20000)])
        return pd.DataFrame({"a": np.concatenate([left.a, left.b]), "b": np.concatenate([left.b, left.a]), "s": np.concatenate([s, s])})

    return p.groupBy("block").cogroup(sent.groupBy("to")).applyInPandas(work, "a long, b long, s float")


def nn_descent(codes: DataFrame, dim: int, *, keep: int = KEEP) -> DataFrame:
    """(a, b, s): the neighbour graph of the routed vectors, improved by rounds of neighbours of neighbours
    until a round changes at most SETTLED of all entries. Lists only improve, so the rounds end."""
    graph = cut(best_lists(leaf_graph(codes, dim, keep), keep), "graph")
    forget(codes)  # the leaves' vectors need not stay on disk
    rows = codes.count()
    before = None
    while True:
        links = cut(links_of(graph), "links")
        pairs = cut(round_pairs(links, before, codes), "pairs")
        worst = graph.groupBy("a").agg(F.min("s").alias("_w"), F.count(F.lit(1)).alias("_n"))
        new = compare(pairs, codes, dim).join(worst, "a", "left").filter(F.col("_w").isNull() | (F.col("_n") < keep) | (F.col("s") > F.col("_w"))).select("a", "b", "s")
        better = cut(new, "better")
        forget(codes)
        # what is listed already is looked up from the pairs' side, as they are few; only lists that get a row are made anew
        there = graph.join(better.select("a", "b"), ["a", "b"], "left_semi").select("a", "b")
        new = cut(better.join(there, ["a", "b"], "left_anti"), "new")
        release(better)
        changed = new.count()
        if changed:
            rows_of = new.select("a").distinct()
            merged = best_lists(graph.join(rows_of, "a", "left_semi").unionByName(new), keep).unionByName(graph.join(rows_of, "a", "left_anti"))
            merged = cut(merged, "graph")
            release(graph)
            graph = merged
        release(pairs)
        release(new)
        if before is not None:
            release(before)
        before = links
        forget(codes)
        if changed <= SETTLED * rows * keep:
            break
    release(before)
    return graph


def collapse(codes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Codes with one row (the least id) for each set of copies, and (rep, id) of the copies, or None if there are none."""
    key = F.xxhash64("code")
    g = codes.groupBy(key.alias("h"), F.hash("code").alias("h2")).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    g = cut(g, "copies")
    if not g.limit(1).count():
        return codes, None
    members = cut(codes.select("id", key.alias("h"), F.hash("code").alias("h2")).join(g.select("h", "h2", "rep"), ["h", "h2"]).select("rep", "id"), "members")
    return cut(codes.join(members.filter("id != rep").select("id"), "id", "left_anti"), "codes"), members


def expand(graph: DataFrame, members: DataFrame | None, k: int) -> DataFrame:
    """Lists of k for every row, copies included. Copies list the first copies of their own set, then what
    their representative lists; a listed representative stands for the first COPIES of its set."""
    if members is None:
        return top_lists(graph, k)
    first = Window.partitionBy("rep").orderBy("id")
    few = members.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= COPIES).select("rep", "id")
    b = few.select(F.col("rep").alias("b"), F.col("id").alias("b2"))
    wide = graph.join(b, "b", "left").select("a", F.coalesce("b2", "b").alias("b"), "s")
    wide = top_lists(wide, k)
    a = members.select(F.col("rep").alias("a"), F.col("id").alias("a2"))
    others = wide.join(a, "a", "left").select(F.coalesce("a2", "a").alias("a"), "b", "s")
    own = members.select("rep", F.col("id").alias("a")).join(few.select("rep", F.col("id").alias("b")), "rep").filter("a != b").select("a", "b", F.lit(1.0).cast("float").alias("s"))
    return top_lists(others.unionByName(own), k)


def nearest(df: DataFrame, key: str, vec: str, dim: int, k: int, *, keep: int = KEEP, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """(a, b, s): the k most similar rows of every usable row by cosine, most of them: see README for the
    measured recall.

    Vectors of 8 bits a number are routed through trees of two-means splits (fitted on at most SAMPLE
    rows) whose leaves give the lists to begin from, and rounds of NN-descent compare neighbours of
    neighbours that were in no leaf together. s is exact to about 0.002. Sets of copies are searched once and
    filled in afterwards, so one vector held by a third of all rows costs no more than another. Rows
    that are not usable give none; keys are whole numbers; ties go to the lesser key.
    """
    reps, members = encode(df, key, vec, dim, trees, leaf)
    return expand(nn_descent(reps, dim, keep=keep), members, k)


def exact_cosine(pairs: DataFrame, df: DataFrame, key: str, vec: str, dim: int) -> DataFrame:
    """``pairs`` (a, b) with cos, from the whole vectors."""
    u = usable(df, key, vec, dim).select(F.col(key).cast("long").alias("id"), F.transform(vec, lambda x: x.cast("double")).alias("v"))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    few = cut(u.join(ids, "id", "left_semi"), "exact")
    j = pairs.join(few.select(F.col("id").alias("a"), F.col("v").alias("va")), "a").join(few.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    return j.withColumn("cos", dot("va", "vb") / (F.sqrt(dot("va", "va")) * F.sqrt(dot("vb", "vb")))).drop("va", "vb")


def greedy_search(graph: DataFrame, codes: DataFrame, queries: DataFrame, dim: int, k: int, *, beam: int = 32, entries: int = 32) -> DataFrame:
    """(q, b, s): the k most similar rows of each query row, by greedy search in the neighbour graph.

    ``queries`` has (q, code, scale, leaves). Every query is routed to its leaf of each tree, begins at
    ``entries`` fixed rows of each, and goes on from the neighbours (both ways) of its ``beam`` best rows
    not yet opened, until no query has one left. A query itself is never among its results.
    """
    both = cut(graph.select("a", "b").unionByName(graph.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().withColumn("_h", F.xxhash64("a", "b")), "links")
    w = Window.partitionBy("a").orderBy("_h")
    links = cut(both.withColumn("_r", F.row_number().over(w)).filter("_r <= 12").select("a", "b").unionByName(graph.select("a", "b")).distinct(), "links")
    leaf = Window.partitionBy("t", "leaf").orderBy("_h", "b")
    start = codes.select(F.col("id").alias("b"), F.posexplode("leaves").alias("t", "leaf")).withColumn("_h", F.xxhash64("b")).withColumn("_r", F.row_number().over(leaf)).filter(F.col("_r") <= entries).select("t", "leaf", "b")

    def score(pairs: DataFrame) -> DataFrame:
        j = pairs.join(queries.select("q", "code", "scale"), "q").join(codes.select(F.col("id").alias("b"), F.col("code").alias("c2"), F.col("scale").alias("s2")), "b")

        def work(it):
            for pdf in it:
                if len(pdf):
                    s = np.einsum("ij,ij->i", unpack(pdf.code, pdf.scale, dim), unpack(pdf.c2, pdf.s2, dim))
                    yield pd.DataFrame({"q": pdf.q, "b": pdf.b, "s": s})

        return j.mapInPandas(work, "q long, b long, s float")

    wq = Window.partitionBy("q").orderBy(F.col("s").desc(), "b")
    first = queries.select("q", F.posexplode("leaves").alias("t", "leaf")).join(start, ["t", "leaf"]).select("q", "b").distinct()
    seen = cut(score(first).withColumn("open", F.lit(False)), "seen")
    while True:
        best = seen.withColumn("_r", F.row_number().over(wq)).filter(F.col("_r") <= beam)
        todo = best.filter(~F.col("open")).select("q", F.col("b").alias("a"))
        cand = todo.join(links, "a").select("q", "b").distinct().join(seen.select("q", "b"), ["q", "b"], "left_anti")
        fresh = cut(score(cand), "fresh")
        opened = todo.select("q", F.col("a").alias("b"), F.lit(True).alias("_o"))
        new = cut(
            seen.join(opened, ["q", "b"], "left").select("q", "b", "s", (F.col("open") | F.coalesce("_o", F.lit(False))).alias("open"))
            .unionByName(fresh.withColumn("open", F.lit(False))), "seen")
        more = fresh.limit(1).count()
        release(seen)
        release(fresh)
        seen = new
        if not more:
            break
    return seen.filter("q != b").withColumn("_r", F.row_number().over(wq)).filter(F.col("_r") <= k).select("q", "b", "s")
