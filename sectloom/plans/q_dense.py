"""Dense vectors and the similarity graph: D02-D14, G01-G15."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sectloom.functions.text import tokenize
from sectloom.functions.vec import dot, norm
from sectloom.operators import dense as D
from sectloom.operators import lexical as L
from sectloom.operators import simgraph as S
from sectloom.plans.base import post, sections
from sectloom.plans.registry import CORE
from sectloom.plans.runtime import cut, forget, table
from sectloom.plans.sqlparts import POST

_E = """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"""
_P = _E + ", p AS (SELECT x.vec_id AS a, y.vec_id AS b, round(list_inner_product(x.v, y.v), 6) AS s FROM e x JOIN e y ON x.vec_id < y.vec_id)"


def _emb(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def _knn(spark, d, k):
    e = _emb(spark, d)
    return D.block_topk(e, e, "vec_id", "v", k)


def _dense_edges(spark, d, k=15):
    """Neighbour edges of the embeddings, canonical."""
    n = _knn(spark, d, k)
    return cut(n.select(F.least("query", "vec_id").alias("a"), F.greatest("query", "vec_id").alias("b"), "s").distinct(), "dense")


@CORE("d02_centred_norms", sql=_E + ", m AS (SELECT i, avg(v[i]) AS mu FROM e, (SELECT unnest(range(1, 65)) AS i) GROUP BY i) SELECT vec_id, round(sqrt(sum((v[i] - mu) * (v[i] - mu))), 6) AS n FROM e, m GROUP BY vec_id")
def d02(spark, d):
    """Length of every vector once the mean is taken off."""
    e = _emb(spark, d)
    x = e.crossJoin(F.broadcast(D.mean_vector(e, "v")))  # one row
    return x.select("vec_id", F.round(norm(F.zip_with("v", "mu", lambda a, m: a - m)), 6).alias("n"))


_TOPK = _E + ", p AS (SELECT q.vec_id AS query, e.vec_id, round(list_inner_product(q.v, e.v), 6) AS s FROM e q JOIN e ON q.vec_id <> e.vec_id AND q.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, vec_id) AS rank FROM p) SELECT query, vec_id, s, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10"


@CORE("d03_dense_search", sql=_TOPK)
def d03(spark, d):
    """Exact search: the ten rows most similar to every row whose id is divisible by 100, against all rows."""
    e = _emb(spark, d)
    return D.block_topk(e, e.filter("vec_id % 100 = 0"), "vec_id", "v", 10)


@CORE("d04_label_similarity", sql=_E + ", c AS (SELECT label, i, avg(v[i]) AS mu FROM e, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL), n AS (SELECT label, sqrt(sum(mu * mu)) AS l FROM c GROUP BY label) SELECT vec_id, round(sum(v[i] * mu) / any_value(l), 6) AS s FROM e JOIN c USING (label) JOIN n USING (label) GROUP BY vec_id")
def d04(spark, d):
    """Similarity of every row to its label's centroid."""
    e = _emb(spark, d)
    return e.join(D.centroids(e, "label", "v"), "label").select("vec_id", F.round(dot("v", "mu") / norm("mu"), 6).alias("s"))


@CORE("d05_exact_knn", sql=_E + ", p AS (SELECT q.vec_id AS query, e.vec_id, round(list_inner_product(q.v, e.v), 6) AS s FROM e q JOIN e ON q.vec_id <> e.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, vec_id) AS rank FROM p) SELECT query, vec_id, s, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5")
def d05(spark, d):
    """Exact neighbours of every row by block products."""
    return _knn(spark, d, 5)


@CORE("d06_cell_knn")
def d06(spark, d):
    """Approximate neighbours of every row: the rows of its nearest cells (recall is tested against d05)."""
    return D.cell_topk(_emb(spark, d), "vec_id", "v", 5, cells=64, probe=12)


@CORE("d07_pair_similarities", sql=_E + " SELECT x.vec_id AS a, y.vec_id AS b, round(list_inner_product(x.v, y.v), 6) AS s FROM e x JOIN e y ON y.vec_id = x.vec_id + 1")
def d07(spark, d):
    """Exact similarity of stated pairs: every row and the next."""
    e = _emb(spark, d)
    b = e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("v").alias("w"))
    return e.select(F.col("vec_id").alias("a"), "v").join(b, "a").select("a", "b", F.round(dot("v", "w"), 6).alias("s"))


@CORE("d08_genre_share")
def d08(spark, d):
    """Share of each vector along the three directions in which members of one label differ most."""
    return D.without_axes(_emb(spark, d), "vec_id", "v", "label", 3).select("vec_id", F.round("share", 4).alias("share"))


@CORE("d09_medoids", sql=_E + ", c AS (SELECT label, i, avg(v[i]) AS mu FROM e, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL), n AS (SELECT label, sqrt(sum(mu * mu)) AS l FROM c GROUP BY label), s AS (SELECT label, vec_id, round(sum(v[i] * mu) / (any_value(l) * sqrt(list_inner_product(any_value(v), any_value(v)))), 6) AS s FROM e JOIN c USING (label) JOIN n USING (label) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS r FROM s) SELECT label, vec_id, s FROM r WHERE r = 1")
def d09(spark, d):
    """The row nearest each label's centroid."""
    return D.medoids(_emb(spark, d), "vec_id", "label", "v")


_SEEDED = "(CAST(('0x' || md5('null:' || vec_id)[1:12]) AS BIGINT) + 0.5) / 281474976710656.0 < 2000.0 / (SELECT count(*) FROM e)"
_NULL = _E + f", p AS (SELECT round(list_inner_product(x.v, y.v), 4) AS s FROM (SELECT * FROM e WHERE {_SEEDED}) x JOIN e y ON x.vec_id <> y.vec_id), h AS (SELECT s, count(*) AS n FROM p GROUP BY s), c AS (SELECT s, n, sum(n) OVER (ORDER BY s) AS upto, sum(n) OVER () AS total FROM h)"


def _seeded(e):
    """About 2,000 rows by a hash of the id: the rows whose similarities to all rows are the null."""
    u = (F.conv(F.substring(F.md5(F.concat(F.lit("null:"), F.col("vec_id").cast("string"))), 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)
    return e.filter(u < 2000.0 / max(1, e.count()))


@CORE("d10_similarity_percentiles", sql=_NULL + " SELECT CAST(q AS DOUBLE) AS q, min(s) AS s FROM c, (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95]) AS q) WHERE upto >= q * total GROUP BY q")
def d10(spark, d):
    """Percentiles of the similarities of seeded rows to all rows: the null distribution that scores are scaled by."""
    e = _emb(spark, d)
    h = cut(D.similarity_counts(e, "vec_id", "v", 4, _seeded(e)), "null")
    c = h.select("s", F.sum("n").over(Window.orderBy("s")).alias("upto")).crossJoin(F.broadcast(h.agg(F.sum("n").alias("total"))))  # 20,001 rows at most, and one
    c = c.withColumn("q", F.explode(F.array(*[F.lit(q) for q in (0.05, 0.25, 0.5, 0.75, 0.95)])))
    return c.filter(F.col("upto") >= F.col("q") * F.col("total")).groupBy("q").agg(F.min("s").alias("s"))


@CORE("d11_truncated_vectors", sql="WITH e AS (SELECT vec_id, list_transform(embedding[1:16], lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings) SELECT vec_id, round(sqrt(list_inner_product(v, v)), 6) AS n FROM e")
def d11(spark, d):
    """Length of the first sixteen numbers of each vector."""
    return _emb(spark, d).select("vec_id", F.round(norm(F.slice("v", 1, 16)), 6).alias("n"))


@CORE("d13_hashed_embedding")
def d13(spark, d):
    """Hashed bags of tokens of the sections: length of each vector."""
    s = sections(spark, d).filter("text IS NOT NULL")
    return D.hashed_embedding(s, "record_id", tokenize(F.col("text")), 64).select("record_id", F.round(norm("vec"), 6).alias("n"))


_COS = POST + """, v AS (SELECT record_id, term, w FROM wt WHERE df <= n / 2), nr AS (SELECT record_id, sqrt(sum(w * w)) AS l FROM v GROUP BY record_id), u AS (SELECT record_id, term, w / l AS u FROM v JOIN nr USING (record_id)),
p AS (SELECT x.record_id AS a, y.record_id AS b, round(sum(x.u * y.u), 6) AS s FROM u x JOIN u y ON x.term = y.term AND x.record_id < y.record_id GROUP BY ALL) """


def _unit(spark, d):
    """Unit rows of BM25 weights, without the terms of more than half of the sections."""
    w = L.weights(post(spark, d), "record_id").filter(F.col("df") <= F.col("n") / 2)
    return L.unit_rows(w, "record_id").select("record_id", "term", "u")


@CORE("g01_sparse_cosines", sql=_COS + ", y AS (SELECT a, s FROM p WHERE s >= 0.02 UNION ALL SELECT b, s FROM p WHERE s >= 0.02) SELECT record_id, count(a) AS links, coalesce(max(s), 0) AS strongest FROM nr LEFT JOIN y ON a = record_id GROUP BY record_id")
def g01(spark, d):
    """For every section the number of others with a sparse cosine of at least 0.02, and its strongest."""
    return L.count_links(_unit(spark, d), "record_id", 0.02)


@CORE("g02_cut")
def g02(spark, d):
    """Dense neighbour edges two deviations above the mean on a fitted scale."""
    return S.z_scores(_dense_edges(spark, d)).filter("z >= 2").select("a", "b", "s", F.round("z", 6).alias("z"))


@CORE("g03_block_counts", sql=_P + ", k AS (SELECT a, b, s FROM p) SELECT least(x.label, y.label) || '-' || greatest(x.label, y.label) AS block, count(*) AS n, round(avg(s), 6) AS mean FROM k JOIN e x ON x.vec_id = a JOIN e y ON y.vec_id = b WHERE s >= 0.5 GROUP BY block")
def g03(spark, d):
    """Edges of at least 0.5 by pair of labels, order aside: each block of pairs gives counts and sums."""
    return _by_labels(spark, d).filter("hits > 0").groupBy(F.concat_ws("-", "la", "lb").alias("block")).agg(F.sum("hits").alias("n"), F.round(F.sum("total") / F.sum("hits"), 6).alias("mean"))


def _by_labels(spark, d):
    """(la, lb, pairs, hits, total): pairs, those of at least 0.5 and their sum, of each block of pairs, by labels."""
    import numpy as np
    import pandas as pd

    def part(s, l, r):
        x = np.round(s, 6)
        ok = ~np.isnan(x)
        i, j = np.nonzero(ok)
        a, b, v = l["_label"].values[i], r["label"].values[j], x[ok]
        t = pd.DataFrame({"la": np.minimum(a, b), "lb": np.maximum(a, b), "pairs": 1, "hits": (v >= 0.5).astype(int), "total": np.where(v >= 0.5, v, 0.0)})
        return t.groupby(["la", "lb"], as_index=False).sum()

    return D.block_pairs(_emb(spark, d), "vec_id", "v", ["label"], part, "la int, lb int, pairs long, hits long, total double")


@CORE("g04_block_z")
def g04(spark, d):
    """Edges scored against their own pair of labels, or all edges where a pair has under thirty."""
    e = _emb(spark, d).select("vec_id", "label")
    x = _dense_edges(spark, d).join(e.select(F.col("vec_id").alias("a"), F.col("label").alias("la")), "a").join(e.select(F.col("vec_id").alias("b"), F.col("label").alias("lb")), "b")
    x = x.withColumn("block", F.concat_ws("-", F.least("la", "lb").cast("string"), F.greatest("la", "lb").cast("string")))
    n = x.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    own = x.join(n.filter("n >= 30"), "block", "left_semi")
    rest = x.join(n.filter("n < 30"), "block", "left_semi").withColumn("block", F.lit("pooled"))
    return S.z_scores(own.unionByName(rest).select("a", "b", "s", "block"), ["block"]).select("a", "b", "block", F.round("z", 6).alias("z"))


@CORE("g05_block_rates", sql=_P + " SELECT least(x.label, y.label) AS la, greatest(x.label, y.label) AS lb, count(*) AS pairs, round(avg(CASE WHEN s >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM p JOIN e x ON x.vec_id = a JOIN e y ON y.vec_id = b GROUP BY ALL")
def g05(spark, d):
    """Share of pairs of at least 0.5 in every pair of labels."""
    return _by_labels(spark, d).groupBy("la", "lb").agg(F.sum("pairs").alias("pairs"), F.round(F.sum("hits") / F.sum("pairs"), 6).alias("rate"))


@CORE("g06_budget_match", sql=_P + " SELECT a, b, s FROM (SELECT *, row_number() OVER (ORDER BY s DESC, a, b) AS r FROM p) WHERE r <= 2 * (SELECT count(*) FROM e)")
def g06(spark, d):
    """The strongest pairs, twice as many as rows: the edge budget."""
    e = _emb(spark, d)
    return D.strongest_pairs(e, "vec_id", "v", 2 * e.count())


@CORE("g07_backbone", sql=_P + ", y AS (SELECT a, b, s FROM p WHERE s > 0 UNION ALL SELECT b, a, s FROM p WHERE s > 0), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM y) SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM r WHERE r <= 2")
def g07(spark, d):
    """Edges to the two nearest rows of each row."""
    return S.backbone(_dense_edges(spark, d), 2)


def _two_spaces(spark, d):
    """z of neighbour edges in the whole vectors and in their first half."""
    e = _emb(spark, d)
    half = e.select("vec_id", F.slice("v", 1, 32).alias("v"))
    n = D.block_topk(half, half, "vec_id", "v", 15)
    h = cut(n.select(F.least("query", "vec_id").alias("a"), F.greatest("query", "vec_id").alias("b"), "s").distinct(), "half")
    return S.z_scores(_dense_edges(spark, d)).select("a", "b", "z"), S.z_scores(h).select("a", "b", "z")


@CORE("g08_fuse")
def g08(spark, d):
    """Edges of two spaces with provenance and scaled strength."""
    x, y = _two_spaces(spark, d)
    return S.fuse(x.filter("z > 0"), y.filter("z > 0")).select("a", "b", "provenance", F.round("strength", 6).alias("strength"))


@CORE("g11_streamed_edges", sql=_P + ", y AS (SELECT a, b, s FROM p UNION ALL SELECT b, a, s FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM y) SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b, s FROM r WHERE r <= 15 AND s >= 0.5")
def g11(spark, d):
    """Edges of at least 0.5 among the fifteen best of one end."""
    return _dense_edges(spark, d).filter("s >= 0.5")


@CORE("g12_bitmask_fuse")
def g12(spark, d):
    """Edges of two spaces with a bit for each."""
    return S.bitmask_fuse(list(_two_spaces(spark, d))).select("a", "b", F.col("sig").cast("int").alias("sig"), F.round("weight", 6).alias("weight"))


@CORE("g13_lexical_knn", sql=_COS + ", y AS (SELECT a, b, s FROM p UNION ALL SELECT b, a, s FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS rank FROM y) SELECT a, b, s, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5")
def g13(spark, d):
    """The five lexically nearest sections of each."""
    return L.nearest_rows(_unit(spark, d), "record_id", 5)


@CORE("g14_core_edges", sql=_P + """, y AS (SELECT a, b, s FROM p UNION ALL SELECT b, a, s FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM y), k AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM r WHERE r <= 15)
SELECT a, b FROM k JOIN e x ON x.vec_id = a JOIN e y ON y.vec_id = b WHERE x.label = y.label""")
def g14(spark, d):
    """Neighbour edges within one label."""
    e = _emb(spark, d).select("vec_id", "label")
    return _dense_edges(spark, d).join(e.select(F.col("vec_id").alias("a"), F.col("label").alias("x")), "a").join(e.select(F.col("vec_id").alias("b"), F.col("label").alias("y")), "b").filter("x = y").select("a", "b")


@CORE("g09_edge_export", sql=_P + ", y AS (SELECT a, b, s FROM p UNION ALL SELECT b, a, s FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM y), k AS (SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst, s FROM r WHERE r <= 15 AND s >= 0.5), tt AS (SELECT max(created_at) AS t FROM sect_build) SELECT src, dst, 'dense' AS provenance, s AS strength, NULL::DOUBLE AS sim_sparse, s AS sim_dense, t AS valid_from, NULL::TIMESTAMP AS valid_to, t AS ingested_at FROM k, tt")
def g09(spark, d):
    """Edges in the shape they are stored in: canonical ends, provenance, similarities, and the interval they are valid for."""
    at = table(spark, d, "sect_build").agg(F.max("created_at").alias("valid_from"))  # one row
    e = _dense_edges(spark, d).filter("s >= 0.5").crossJoin(F.broadcast(at))
    return e.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("dense").alias("provenance"), F.col("s").alias("strength"), F.lit(None).cast("double").alias("sim_sparse"), F.col("s").alias("sim_dense"), "valid_from", F.lit(None).cast("timestamp_ntz").alias("valid_to"), F.col("valid_from").alias("ingested_at"))


@CORE("g10_null_cut")
def g10(spark, d):
    """The null of positive similarities, from seeded rows against all: Box-Cox power, mean, deviation, excess kurtosis, and the
    similarity whose z is 2. Only counts at each similarity (20,001 at most) leave the tasks."""
    e = _emb(spark, d)
    c = D.similarity_counts(e, "vec_id", "v", 4, _seeded(e)).filter("s > 0.02")
    return S.null_cut(c, 2.0)


@CORE("g15_sparse_only", sql=_COS + ", y AS (SELECT a, b, s FROM p UNION ALL SELECT b, a, s FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM y), k AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b, s AS z FROM r WHERE r <= 5 AND s > 0), o AS (SELECT min(z) AS lo, max(z) AS hi FROM k) SELECT a, b, 'sparse' AS provenance, CASE WHEN hi > lo THEN round((z - lo) / (hi - lo), 6) ELSE 1 END AS strength FROM k, o")
def g15(spark, d):
    """The graph without any dense space: lexical neighbours alone, fused with nothing."""
    t = cut(L.document_tokens(sections(spark, d), "record_id", "text"), "tokens")
    forget(t)
    n = L.nearest_documents(L.unit_documents(t, "record_id"), "record_id", 5)
    x = cut(n.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("s").alias("z")).distinct(), "sparse")
    return S.fuse(x, x.limit(0)).select("a", "b", "provenance", F.round("strength", 6).alias("strength"))


@CORE("c01_section_communities")
def c01(spark, d):
    """Communities of at least five sections of the lexical neighbour graph, with their size, five keywords by summed weight, and the
    medoid: the section whose unit row is most like the sum of all of its community, so nearest to all members together."""
    from sectloom.operators import graph as G

    u = cut(_unit(spark, d), "unit")
    n = L.nearest_rows(u, "record_id", 5)
    e = n.select(F.lit(0).alias("g"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "s").distinct()
    m = cut(G.louvain(e, ["g"]).select(F.col("id").alias("record_id"), "cid"), "members")
    size = m.groupBy("cid").agg(F.count(F.lit(1)).alias("size")).filter("size >= 5")
    x = u.join(m.join(size, "cid"), "record_id")
    mass = x.groupBy("cid", "term").agg(F.round(F.sum("u"), 9).alias("mass"))
    words = L.top(mass, ["cid"], [F.col("mass").desc(), F.col("term")], 5).groupBy("cid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda r: r["term"]).alias("keywords"))
    mid = x.join(mass, ["cid", "term"]).groupBy("cid", "record_id").agg(F.round(F.sum(F.col("u") * F.col("mass")), 9).alias("c")).groupBy("cid").agg(F.max_by("record_id", F.struct("c", -F.col("record_id"))).alias("medoid"))
    return size.join(words, "cid").join(mid, "cid").select("cid", "size", F.array_join("keywords", " ").alias("keywords"), "medoid")
