"""Further community queries: C08, C12, C14."""

from __future__ import annotations

from pyspark.sql import functions as F

from sectloom.functions import stats
from sectloom.functions.vec import dot, norm
from sectloom.operators import dense as D
from sectloom.operators.lexical import top
from sectloom.plans.base import mentions, sections
from sectloom.plans.registry import CORE
from sectloom.plans.runtime import cut, size_bound, table
from sectloom.plans.sqlparts import MENTIONS


@CORE("c08_nearest_centroid", sql="WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), c AS (SELECT label AS cid, i, avg(v[i]) AS mu FROM e, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL), n AS (SELECT cid, sqrt(sum(mu * mu)) AS l FROM c GROUP BY cid), s AS (SELECT vec_id, cid, round(sum(v[i] * mu) / any_value(l), 6) AS s FROM e, c JOIN n USING (cid) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, cid) AS r FROM s) SELECT vec_id, cid, s FROM r WHERE r = 1")
def c08(spark, d):
    """The label whose centroid each vector is nearest to; there is one centroid a label."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    c = cut(D.centroids(e, "label", "v").select(F.col("label").alias("cid"), "mu"), "centroids")
    if not size_bound(c, 10_000):
        raise ValueError("more than 10,000 centroids to compare each row with")
    j = e.crossJoin(F.broadcast(c)).select("vec_id", "cid", F.round(dot("v", "mu") / norm("mu"), 6).alias("s"))  # one row a label
    return top(j, ["vec_id"], [F.col("s").desc(), F.col("cid")], 1).select("vec_id", "cid", "s")


_S = "s AS (SELECT build_id, ord, community AS cid FROM sect_node WHERE community IS NOT NULL AND community >= 0)"


@CORE("c12_entity_enrichment", sql=MENTIONS + f", {_S}, g AS (SELECT build_id, cid, entity_id, CAST(sum(cnt) AS DOUBLE) AS k FROM m JOIN s USING (build_id, ord) GROUP BY ALL), gt AS (SELECT build_id, cid, sum(k) AS z FROM g GROUP BY ALL), al AS (SELECT build_id, entity_id, sum(k) AS t FROM g GROUP BY ALL), tt AS (SELECT build_id, sum(k) AS n FROM g GROUP BY ALL), x AS (SELECT *, 10 * t / n AS a FROM g JOIN gt USING (build_id, cid) JOIN al USING (build_id, entity_id) JOIN tt USING (build_id) WHERE k >= 3 AND t < n) SELECT build_id, cid, entity_id, round((ln((k + a) / (z - k + 10 - a)) - ln((t - k + a) / (n - z - t + k + 10 - a))) / sqrt(1 / (k + a) + 1 / (z - k + 10 - a) + 1 / (t - k + a) + 1 / (n - z - t + k + 10 - a)), 6) AS z FROM x WHERE n > z")
def c12(spark, d):
    """z of an entity's log odds in a community's mentions, with a prior of ten mentions."""
    s = sections(spark, d).filter("community IS NOT NULL AND community >= 0").select("build_id", "ord", F.col("community").alias("cid"))
    g = cut(mentions(spark, d).join(s, ["build_id", "ord"]).groupBy("build_id", "cid", "entity_id").agg(F.sum("cnt").cast("double").alias("k")), "mass")
    j = g.join(g.groupBy("build_id", "cid").agg(F.sum("k").alias("size")), ["build_id", "cid"]).join(g.groupBy("build_id", "entity_id").agg(F.sum("k").alias("t")), ["build_id", "entity_id"]).join(g.groupBy("build_id").agg(F.sum("k").alias("n")), "build_id")
    j = j.filter("k >= 3 AND t < n AND n > size")
    return j.select("build_id", "cid", "entity_id", F.round(stats.log_odds_z(F.col("k"), F.col("size"), F.col("t"), F.col("n"), 10.0, F.col("t") / F.col("n")), 6).alias("z"))


@CORE("c14_label_budget", sql="WITH c AS (SELECT community AS cid, count(*) AS n FROM sect_node WHERE community >= 0 GROUP BY ALL), m AS (SELECT median(n) AS m FROM c) SELECT cid, n, CASE WHEN n < m / 2 THEN 3 WHEN n <= 2 * m THEN 5 ELSE 8 END AS terms FROM c, m")
def c14(spark, d):
    """Number of label terms a community is given by its size against the median."""
    c = sections(spark, d).filter("community >= 0").groupBy(F.col("community").alias("cid")).agg(F.count(F.lit(1)).alias("n"))
    m = c.agg(F.median("n").alias("m"))
    return c.crossJoin(F.broadcast(m)).select("cid", "n", F.when(F.col("n") < F.col("m") / 2, 3).when(F.col("n") <= 2 * F.col("m"), 5).otherwise(8).alias("terms"))  # one row
