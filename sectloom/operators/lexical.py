"""Inverted index, BM25 search and its relatives."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sectloom.functions import stats
from sectloom.functions.text import tokenize
from sectloom.plans.runtime import cut


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf) under the index tokenizer; documents without tokens have none."""
    t = docs.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, F.explode(tokenize(F.col(text))).alias("term"))
    return t.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def document_tokens(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, h): one row a document with index tokens: the hash of each token, as often as it occurs. Tokens are never rows of
    their own, so they are moved once, by key."""
    t = docs.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, F.transform(tokenize(F.col(text)), lambda x: F.xxhash64(x)).alias("h"))
    return t.filter(F.size("h") > 0).groupBy(key).agg(F.flatten(F.collect_list("h")).alias("h"))


def token_freq(rows: DataFrame) -> DataFrame:
    """(h, df) of :func:`document_tokens`."""
    return rows.select(F.explode(F.array_distinct("h")).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("df"))


def _opened(path: str):
    """A dataset of a folder in the shared storage."""
    from pyarrow import dataset, fs

    f, p = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return dataset.dataset(p, filesystem=f, format="parquet", exclude_invalid_files=False)


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """All items of a column of lists, and the length of each."""
    size = column.map(len).values.astype(np.int64)
    return np.concatenate(column.values) if len(column) else np.zeros(0), size


def unit_documents(tokens: DataFrame, key: str) -> DataFrame:
    """(key, h, w): BM25 weights of each document's terms, without those in more than half of the documents, at unit length, from
    ``tokens`` of :func:`document_tokens`. Frequencies are read by each task from the shared folder; no document is moved."""
    one = tokens.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("h")).alias("avgdl")).first()
    n, avgdl, kt = one.n, float(one.avgdl or 1.0), tokens.schema[key].dataType.simpleString()
    path = cut(token_freq(tokens), "freq")._sectloom_path

    def work(it):
        t = _opened(path).to_table()
        h, df = t["h"].to_numpy(), t["df"].to_numpy().astype(float)
        order = np.argsort(h)
        h, df = h[order], df[order]
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        for pdf in it:
            if not len(pdf):
                continue
            items, dl = _lists(pdf["h"])
            code, tf = np.unique(np.repeat(np.arange(len(pdf)), dl) * len(h) + np.searchsorted(h, items), return_counts=True)
            row, at = code // len(h), code % len(h)
            w = idf[at] * tf * (stats.K1 + 1) / (tf + stats.K1 * (1 - stats.B + stats.B * dl[row] / avgdl))
            row, at, w = (x[df[at] <= n / 2] for x in (row, at, w))
            w = w / np.sqrt(np.bincount(row, w * w, len(pdf)))[row]
            ends = np.cumsum(np.bincount(row, minlength=len(pdf)))[:-1]
            yield pd.DataFrame({key: pdf[key], "h": np.split(h[at], ends), "w": np.split(w, ends)})

    return tokens.select(key, "h").mapInPandas(work, f"{key} {kt}, h array<long>, w array<double>").filter(F.size("h") > 0)


def nearest_documents(rows: DataFrame, key: str, k: int, block: int = 4096, most: int = 1024) -> DataFrame:
    """(a, b, s, rank): as :func:`nearest_rows`, of rows (key, h, w) of unit length.

    Rows are written once; every task compares its own with all, read block by block from the shared folder, so nothing is
    moved or kept but k neighbours a row. Frequent terms are columns of a product in single precision, the others are added
    pair by pair; what comes within the k best up to the product's error is made again in double precision.
    """
    kt = rows.schema[key].dataType.simpleString()
    rows = cut(rows, "rows")
    path, n = rows._sectloom_path, rows.count()
    df = rows.select(F.explode("h").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") * 64 > n)
    often = np.sort(np.array([r.h for r in df.orderBy(F.col("df").desc(), "h").limit(most).collect()], np.int64))

    def split(pdf):
        """Columns of frequent terms, and (row, term, weight) of the others, by term."""
        h, size = _lists(pdf["h"])
        w, row = _lists(pdf["w"])[0], np.repeat(np.arange(len(pdf)), size)
        at = np.minimum(np.searchsorted(often, h), max(0, len(often) - 1))
        hit = often[at] == h if len(often) else np.zeros(len(h), bool)
        m = np.zeros((len(pdf), len(often)))
        m[row[hit], at[hit]] = w[hit]
        row, h, w = row[~hit], h[~hit], w[~hit]
        order = np.argsort(h, kind="stable")
        return m, row[order], h[order], w[order]

    def search(left):
        ka = np.asarray(left[key])
        ma, ra, ha, wa = split(left)
        order = np.argsort(ra, kind="stable")
        ra, ha, wa = ra[order], ha[order], wa[order]
        fa = ma.astype(np.float32)
        bi, bb, bs = np.zeros(0, np.int64), ka[:0], np.zeros(0)
        least = np.full(len(left), 1e-9)
        for batch in _opened(path).to_batches(columns=[key, "h", "w"], batch_size=block, batch_readahead=1, fragment_readahead=1):
            right = batch.to_pandas()
            if not len(right):
                continue
            kb = np.asarray(right[key])
            mb, rb, hb, wb = split(right)
            fb = mb.astype(np.float32)
            lo, many = np.searchsorted(hb, ha), np.searchsorted(hb, ha, side="right")
            many -= lo
            for at in range(0, len(left), 1024):
                to = min(at + 1024, len(left))
                rest = np.zeros((to - at, len(right)))
                f, t = np.searchsorted(ra, (at, to))
                m = many[f:t]
                x = np.repeat(np.arange(f, t), m)
                y = np.arange(len(x)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(lo[f:t], m)
                np.add.at(rest, (ra[x] - at, rb[y]), wa[x] * wb[y])
                s = fa[at:to] @ fb.T + rest.astype(np.float32)
                s[ka[at:to, None] == kb[None, :]] = -1
                floor = least[at:to].copy()
                hit = s >= floor[:, None]
                full = np.flatnonzero(hit.sum(1) > 4 * k)
                if len(full):
                    floor[full] = np.maximum(floor[full], np.partition(s[full], -k, axis=1)[:, -k] - 1e-5)
                    hit[full] = s[full] >= floor[full, None]
                i, j = np.nonzero(hit)
                v = np.concatenate([np.einsum("ij,ij->i", ma[at + i[z : z + 4096]], mb[j[z : z + 4096]]) for z in range(0, len(i), 4096)] or [np.zeros(0)])
                v = np.round(v + rest[i, j], 6)
                i, j, v = i[v > 0], j[v > 0], v[v > 0]
                bi, bb, bs = np.concatenate([bi, at + i]), np.concatenate([bb, kb[j]]), np.concatenate([bs, v])
            order = np.lexsort((bb, -bs, bi))
            bi, bb, bs = bi[order], bb[order], bs[order]
            rank = np.arange(len(bi)) - np.searchsorted(bi, bi)
            bi, bb, bs, rank = (x[rank < k] for x in (bi, bb, bs, rank))
            least[bi[rank == k - 1]] = bs[rank == k - 1] - 1e-5
        rank = np.arange(len(bi)) - np.searchsorted(bi, bi)
        return pd.DataFrame({"a": ka[bi], "b": bb, "s": bs, "rank": rank + 1})

    def work(it):
        for pdf in it:
            if len(pdf):
                yield search(pdf)

    return rows.mapInPandas(work, f"a {kt}, b {kt}, s double, rank int")


def truth_ranks(rows: DataFrame, key: str, queries: DataFrame, qkey: str, block: int = 16384, qblock: int = 65536) -> DataFrame:
    """(qkey, truth, better): for every query (qkey, term) of which a document holds a term, the BM25 score of the document with
    the query's own key, null if it holds none, and the number of documents with a strictly better one. Scores have 6 digits.

    Blocks of queries meet blocks of documents (``rows`` of :func:`document_tokens`); only a count for each query leaves a task,
    never the hits. Queries are small, so their blocks are long and documents are moved once in most collections.
    """
    kt, qt = rows.schema[key].dataType.simpleString(), queries.schema[qkey].dataType.simpleString()
    one = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("h")).alias("avgdl")).first()
    n, avgdl = one.n, float(one.avgdl or 1.0)
    q = queries.filter(F.col(qkey).isNotNull()).select(qkey, F.xxhash64("term").alias("h")).distinct()
    q = cut(q.join(token_freq(rows), "h").select(qkey, "h", "df"), "queries")
    own = rows.select(F.col(key).alias(qkey), "h").join(q.select(qkey).distinct(), qkey, "left_semi").select(qkey, F.size("h").alias("dl"), F.explode("h").alias("h"))
    own = own.groupBy(qkey, "dl", "h").agg(F.count(F.lit(1)).alias("tf"))
    w = stats.bm25(F.col("tf"), F.col("df"), F.col("dl"), F.lit(n), F.lit(avgdl))
    truth = own.join(q, [qkey, "h"]).groupBy(qkey).agg(F.round(F.sum(w), 6).alias("truth"))
    asked = q.groupBy(qkey).agg(F.collect_list(F.struct("h", stats.idf(F.lit(n), F.col("df")).alias("idf"))).alias("t")).join(truth, qkey, "left")
    asked = cut(asked.select(qkey, "truth", F.transform("t", lambda x: x["h"]).alias("_h"), F.transform("t", lambda x: x["idf"]).alias("_idf")), "asked")
    nb, nq = max(1, -(-n // block)), max(1, -(-asked.count() // qblock))
    left = asked.filter("truth IS NOT NULL").withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(nb - 1)))).withColumn("_p", F.pmod(F.xxhash64(qkey), F.lit(nq)) * nb + F.col("_b")).drop("_b")
    right = rows.select("h", F.pmod(F.xxhash64(key), F.lit(nb)).alias("_b"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("_q")).select("h", (F.col("_q") * nb + F.col("_b")).alias("_p2"))

    def work(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({qkey: [], "better": []})
        asked_h = np.concatenate(a["_h"].values)
        terms, where = np.unique(asked_h, return_index=True)
        idf = np.concatenate(a["_idf"].values)[where]
        dl = b["h"].map(len).values
        h = np.concatenate(b["h"].values)
        at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
        hit = terms[at] == h
        code, tf = np.unique(at[hit] * len(b) + np.repeat(np.arange(len(b)), dl)[hit], return_counts=True)  # by term, then document
        at, row = code // len(b), code % len(b)
        weight = idf[at] * tf * (stats.K1 + 1) / (tf + stats.K1 * (1 - stats.B + stats.B * dl[row] / avgdl))
        ends = np.searchsorted(at, np.arange(len(terms) + 1))
        score, out = np.zeros(len(b)), np.zeros(len(a), np.int64)
        places = np.split(np.searchsorted(terms, asked_h), np.cumsum(a["_h"].map(len).values)[:-1])
        for i, (ts, t) in enumerate(zip(places, a["truth"].values)):
            score[:] = 0
            for x in ts:
                lo, hi = ends[x], ends[x + 1]
                score[row[lo:hi]] += weight[lo:hi]  # a document has a term once
            more = score[score > t + 4e-7]
            out[i] = np.count_nonzero(np.round(more, 6) > t)
        return pd.DataFrame({qkey: a[qkey].values, "better": out})

    better = left.groupBy("_p").cogroup(right.groupBy("_p2")).applyInPandas(work, f"{qkey} {qt}, better long").groupBy(qkey).agg(F.sum("better").alias("better"))
    return asked.select(qkey, "truth").join(better, qkey, "left").fillna(0, ["better"])


def doc_lengths(post: DataFrame, key: str) -> DataFrame:
    return post.groupBy(key).agg(F.sum("tf").alias("dl"))


def doc_freq(post: DataFrame) -> DataFrame:
    """(term, df, cf)."""
    return post.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def corpus_size(post: DataFrame, key: str) -> DataFrame:
    """One row: documents and their average length."""
    return doc_lengths(post, key).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def weights(post: DataFrame, key: str, k1: float = stats.K1, b: float = stats.B) -> DataFrame:
    """(key, term, tf, df, n, w): BM25 weight of every posting."""
    one = corpus_size(post, key)
    j = post.join(doc_freq(post), "term").join(doc_lengths(post, key), key).crossJoin(F.broadcast(one))  # one row
    return j.select(key, "term", "tf", "df", "n", "dl", stats.bm25(F.col("tf"), F.col("df"), F.col("dl"), F.col("n"), F.col("avgdl"), k1, b).alias("w"))


def top(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group in a total order, numbered."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= k)


def search(w: DataFrame, key: str, queries: DataFrame, qkey: str, qtext: str, k: int) -> DataFrame:
    """(qkey, key, score, terms_hit, rank): the k best documents of each query; ties go to the lesser key."""
    terms = queries.select(qkey, F.explode(F.array_distinct(tokenize(F.col(qtext)))).alias("term"))
    hits = terms.join(w.select(key, "term", "w"), "term").groupBy(qkey, key).agg(F.round(F.sum("w"), 6).alias("score"), F.count(F.lit(1)).alias("terms_hit"))
    return top(hits, [qkey], [F.col("score").desc(), F.col(key)], k)


def unit_rows(w: DataFrame, key: str, weight: str = "w") -> DataFrame:
    """Weights of each row divided by the row's length."""
    n = w.groupBy(key).agg(F.sqrt(F.sum(F.col(weight) * F.col(weight))).alias("_n"))
    return w.join(n, key).withColumn("u", F.col(weight) / F.col("_n")).drop("_n")


def block_cosines(u: DataFrame, key: str, part, schema: str, block: int = 512) -> DataFrame:
    """What ``part(s, a, b)`` makes of the cosines of all pairs of two blocks of sparse unit rows (key, term, u): ``s`` has
    a row for each key of ``a`` and a column for each of ``b``; a pair of a row with itself is NaN.

    Rows become arrays of term hashes and weights, blocks are numbered by a hash of the key, and each pair of blocks
    is one product over the terms that both hold. A frequent term costs a column there, not all its pairs.
    """
    kt = u.schema[key].dataType.simpleString()
    rows = u.groupBy(key).agg(F.collect_list(F.struct(F.xxhash64("term").alias("h"), F.col("u").alias("u"))).alias("t")).select(key, F.transform("t", lambda x: x["h"]).alias("h"), F.transform("t", lambda x: x["u"]).alias("w"))
    rows = cut(rows, "rows")
    n = max(1, -(-rows.count() // block))
    home = F.pmod(F.xxhash64(key), F.lit(n)).cast("long")
    other = F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    left = rows.select(F.col(key).alias("_k"), F.col("h").alias("_h"), F.col("w").alias("_w"), home.alias("_x"), other.alias("_y")).withColumn("_p", F.col("_x") * n + F.col("_y"))
    right = rows.select(key, "h", "w", home.alias("_x"), other.alias("_y")).withColumn("_p2", F.col("_y") * n + F.col("_x"))
    left = left.select("_k", "_h", "_w", "_p")

    def work(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=[c.split()[0] for c in schema.format(kt=kt).split(", ")])
        ha, hb = np.concatenate(a["_h"].values), np.concatenate(b["h"].values)
        terms = np.intersect1d(ha, hb)

        def dense(h, w, size):
            at = np.minimum(np.searchsorted(terms, h), max(0, len(terms) - 1))
            hit = terms[at] == h if len(terms) else np.zeros(len(h), bool)
            m = np.zeros((len(size), len(terms)))
            m[np.repeat(np.arange(len(size)), size)[hit], at[hit]] = w[hit]
            return m

        s = dense(ha, np.concatenate(a["_w"].values), a["_h"].map(len).values) @ dense(hb, np.concatenate(b["w"].values), b["h"].map(len).values).T
        s[a["_k"].values[:, None] == b[key].values[None, :]] = np.nan
        return part(np.round(s, 6), a["_k"].values, b[key].values)

    return left.groupBy("_p").cogroup(right.groupBy("_p2")).applyInPandas(work, schema.format(kt=kt))


def nearest_rows(u: DataFrame, key: str, k: int) -> DataFrame:
    """(a, b, s, rank): the k rows with the largest cosine of each row, of those that share a term; ties: the lesser key."""

    def part(s, a, b):
        order = np.argsort(b, kind="stable")
        s, b = s[:, order], b[order]
        c = np.argsort(np.where(s > 0, -s, np.inf), axis=1, kind="stable")[:, :k]
        v = np.take_along_axis(s, c, 1)
        out = pd.DataFrame({"a": np.repeat(a, c.shape[1]), "b": b[c].ravel(), "s": v.ravel()})
        return out[out.s > 0]

    return top(block_cosines(u, key, part, "a {kt}, b {kt}, s double"), ["a"], [F.col("s").desc(), F.col("b")], k)


def count_links(u: DataFrame, key: str, floor: float) -> DataFrame:
    """(key, links, strongest): for every row the number of others with a cosine of at least ``floor``, and the largest."""

    def part(s, a, b):
        hit = s >= floor
        return pd.DataFrame({"a": a, "links": hit.sum(1), "strongest": np.where(hit, s, 0.0).max(1)})

    return block_cosines(u, key, part, "a {kt}, links long, strongest double").groupBy(F.col("a").alias(key)).agg(F.sum("links").alias("links"), F.max("strongest").alias("strongest"))


def overlapping_sets(sets: DataFrame, key: str, items: str, floor: float, block: int = 8192) -> DataFrame:
    """(a, b, s), a < b: pairs of sets (array<long> without repeats) whose Jaccard overlap is at least ``floor``, each once.

    Each two blocks of sets meet once. Frequent items have a column of their own, the rest share columns, so that one product
    bounds every overlap from above; only pairs whose bound reaches what the sizes ask for are counted exactly, as bits.
    """
    kt = sets.schema[key].dataType.simpleString()
    n = max(1, -(-sets.count() // block))
    home, span = F.pmod(F.xxhash64(key), F.lit(n)), lambda lo, hi: F.explode(F.sequence(lo, hi))
    rows = sets.select(key, items, home.alias("_x"))
    left = rows.withColumn("_y", span(F.col("_x"), F.lit(n - 1).cast("long"))).select(F.col(key).alias("_k"), F.col(items).alias("_i"), (F.col("_x") * n + F.col("_y")).alias("_p"))
    right = rows.withColumn("_y", span(F.lit(0).cast("long"), F.col("_x"))).select(key, items, (F.col("_y") * n + F.col("_x")).alias("_p2"))
    own, shared, need = 256, 128, floor / (1 + floor)

    def work(group, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=["a", "b", "s"])
        same = group[0] // n == group[0] % n
        na, nb = a["_i"].map(len).values, b[items].map(len).values
        words, at, often = np.unique(np.concatenate([*a["_i"].values, *b[items].values]), return_inverse=True, return_counts=True)
        rank = np.empty(len(words), np.int64)
        rank[np.argsort(-often, kind="stable")] = np.arange(len(words))
        at = rank[at]
        column = np.where(at < own, at, own + at % shared)

        def side(lo, hi, size, first, last):
            row = np.repeat(np.arange(len(size)), size)
            m = np.zeros((len(size), own + shared + 2), np.float32)
            np.add.at(m, (row, column[lo:hi]), 1)
            m[:, -2], m[:, -1] = first, last
            bits = np.zeros((len(size), -(-len(words) // 64)), np.uint64)
            np.bitwise_or.at(bits, (row, at[lo:hi] // 64), np.uint64(1) << (at[lo:hi] % 64).astype(np.uint64))
            return m, bits

        ma, ba = side(0, na.sum(), na, -need * na, 1)
        mb, bb = side(na.sum(), len(at), nb, 1, -need * nb)
        ka, kb, out = np.asarray(a["_k"]), np.asarray(b[key]), []
        for lo in range(0, len(a), 1024):
            i, j = np.divmod(np.flatnonzero(ma[lo : lo + 1024] @ mb.T > -1e-3), len(b))
            i += lo
            for x in range(0, len(i), 65536):
                p, q = i[x : x + 65536], j[x : x + 65536]
                if same:
                    p, q = p[ka[p] < kb[q]], q[ka[p] < kb[q]]
                c = np.bitwise_count(ba[p] & bb[q]).sum(1, dtype=np.int64)
                s = c / np.maximum(1, na[p] + nb[q] - c)
                p, q, s = p[s >= floor], q[s >= floor], s[s >= floor]
                less = ka[p] < kb[q]
                out.append((np.where(less, ka[p], kb[q]), np.where(less, kb[q], ka[p]), s))
        none = [(ka[:0], kb[:0], np.zeros(0))]
        return pd.DataFrame({c: pd.Series(x, dtype=x.dtype) for c, x in zip("abs", map(np.concatenate, zip(*none, *out)))})

    return left.groupBy("_p").cogroup(right.groupBy("_p2")).applyInPandas(work, f"a {kt}, b {kt}, s double")


def pair_cosine(u: DataFrame, key: str, floor: float) -> DataFrame:
    """(a, b, s), a < b: cosines of at least ``floor`` of rows that share a term."""
    x, y = u.select("term", F.col(key).alias("a"), F.col("u").alias("ua")), u.select("term", F.col(key).alias("b"), F.col("u").alias("ub"))
    j = x.join(y, "term").filter("a < b").groupBy("a", "b").agg(F.sum(F.col("ua") * F.col("ub")).alias("s"))
    return j.filter(F.col("s") >= floor)
