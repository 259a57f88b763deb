"""Walks, metrics and communities: N01-N37, C01-C29."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sectloom.functions import stats
from sectloom.operators import graph as G
from sectloom.operators.communities import distinct_surfaces, exemplars, greedy_independent, suppress_contained
from sectloom.operators.lexical import top
from sectloom.plans.base import edges, mentions, sections, symmetric
from sectloom.plans.registry import CORE
from sectloom.plans.runtime import cut, table
from sectloom.plans.sqlparts import EDGES, MENTIONS, SYM

_S = "s AS (SELECT build_id, ord, community AS cid FROM sect_node WHERE community IS NOT NULL AND community >= 0)"
_Y = "WITH " + SYM
#: seeds: the five entities of each build with most edges.
_SEED = _Y + ", dg AS (SELECT build_id, a, count(*) AS deg FROM y GROUP BY ALL), sd AS (SELECT build_id, a AS seed FROM (SELECT *, row_number() OVER (PARTITION BY build_id ORDER BY deg DESC, a) AS r FROM dg) WHERE r <= 5) "


def _sym(spark, d):
    return symmetric(cut(edges(spark, d), "edges"))


def _seeds(y):
    deg = y.groupBy("build_id", F.col("a").alias("seed")).agg(F.count(F.lit(1)).alias("deg"))
    return top(deg, ["build_id"], [F.col("deg").desc(), F.col("seed")], 5).select("build_id", "seed")


def _members(spark, d):
    return sections(spark, d).filter("community IS NOT NULL AND community >= 0").select("build_id", "ord", F.col("community").alias("cid"))


@CORE("n01_neighbours", sql=_Y + ", r AS (SELECT *, row_number() OVER (PARTITION BY build_id, a ORDER BY s DESC, b) AS rank FROM y WHERE s >= 0.05) SELECT build_id, a, b, round(s, 6) AS s, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10")
def n01(spark, d):
    """The ten strongest neighbours of every node."""
    return top(_sym(spark, d).filter("s >= 0.05"), ["build_id", "a"], [F.col("s").desc(), F.col("b")], 10).withColumn("s", F.round("s", 6))


@CORE("n02_list_runs", sql="SELECT b.build_id, tag, created_at, json_extract_string(params, '$.run_id') AS run_id, count(n.record_id) AS n_nodes, count(DISTINCT CASE WHEN community >= 0 THEN community END) AS n_communities FROM sect_build b LEFT JOIN sect_node n USING (build_id) GROUP BY ALL")
def n02(spark, d):
    """Builds with counted nodes and communities."""
    b = table(spark, d, "sect_build").select("build_id", "tag", "created_at", F.get_json_object("params", "$.run_id").alias("run_id"))
    n = sections(spark, d).groupBy("build_id").agg(F.count("record_id").alias("n_nodes"), F.countDistinct(F.when(F.col("community") >= 0, F.col("community"))).alias("n_communities"))
    return b.join(n, "build_id", "left").fillna(0, ["n_nodes", "n_communities"])


_WALK = _SEED.replace("WITH ", "WITH RECURSIVE ", 1) + ", w AS (SELECT build_id, seed, seed AS node, CAST(1.0 AS DOUBLE) AS score, 0 AS hop, [seed] AS path FROM sd UNION ALL SELECT w.build_id, seed, y.b, w.score * y.s, hop + 1, list_append(path, y.b) FROM w JOIN y ON y.build_id = w.build_id AND y.a = w.node WHERE hop < 2 AND NOT list_contains(path, y.b) AND w.score * y.s > 0.02), bb AS (SELECT *, row_number() OVER (PARTITION BY build_id, seed, node ORDER BY round(score, 9) DESC, hop, path) AS r FROM w WHERE hop > 0) "


def _walk(spark, d, hops=2, low=0.02):
    y = _sym(spark, d)
    return G.best_reach(G.expand_paths(y, _seeds(y), hops, low))


@CORE("n03_walk", sql=_WALK + "SELECT build_id, seed, node, round(score, 6) AS score, CAST(hop AS INT) AS hop, array_to_string(path, '>') AS path FROM bb WHERE r = 1")
def n03(spark, d):
    """Best simple path of up to two hops from the busiest nodes to every node they reach."""
    return _walk(spark, d).select("build_id", "seed", "node", F.round("score", 6).alias("score"), "hop", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@CORE("n04_khop", sql=_WALK + "SELECT build_id, seed, node, round(max(score), 6) AS score, CAST(min(hop) AS INT) AS hop FROM w WHERE hop > 0 GROUP BY ALL")
def n04(spark, d):
    """Largest score and fewest hops of every reached node."""
    y = _sym(spark, d)
    return G.expand_paths(y, _seeds(y), 2, 0.02).groupBy("build_id", "seed", "node").agg(F.round(F.max("score"), 6).alias("score"), F.min("hop").alias("hop"))


@CORE("n06_cross_group_edges", sql="WITH " + EDGES + ", b AS (SELECT build_id, json_extract_string(params, '$.run_id') AS run_id FROM sect_build), m AS (SELECT DISTINCT build_id, ord, entity_id FROM mentions JOIN b USING (run_id) WHERE cnt > 0), h AS (SELECT build_id, entity_id, min(doc_id) AS doc FROM m JOIN sect_node USING (build_id, ord) GROUP BY ALL) SELECT e.build_id, a, b, round(s, 6) AS s FROM e JOIN h x ON x.build_id = e.build_id AND x.entity_id = a JOIN h z ON z.build_id = e.build_id AND z.entity_id = b WHERE x.doc <> z.doc")
def n06(spark, d):
    """Edges between entities whose first papers differ."""
    h = mentions(spark, d).join(sections(spark, d).select("build_id", "ord", "doc_id"), ["build_id", "ord"]).groupBy("build_id", "entity_id").agg(F.min("doc_id").alias("doc"))
    e = edges(spark, d).join(h.select("build_id", F.col("entity_id").alias("a"), F.col("doc").alias("da")), ["build_id", "a"]).join(h.select("build_id", F.col("entity_id").alias("b"), F.col("doc").alias("db")), ["build_id", "b"])
    return e.filter("da <> db").select("build_id", "a", "b", F.round("s", 6).alias("s"))


@CORE("n07_induced_edges", sql=_WALK + ", k AS (SELECT build_id, seed, node FROM bb WHERE r = 1 UNION SELECT build_id, seed, seed FROM sd) SELECT e.build_id, seed, a, b FROM e JOIN k x ON x.build_id = e.build_id AND x.node = a JOIN k z USING (build_id, seed) WHERE z.node = b".replace("JOIN k z USING (build_id, seed) WHERE z.node = b", "JOIN k z ON z.build_id = x.build_id AND z.seed = x.seed AND z.node = b").replace("SELECT e.build_id, seed, a, b", "SELECT e.build_id, x.seed, a, b"))
def n07(spark, d):
    """Edges inside the neighbourhood of each seed."""
    y = _sym(spark, d)
    s = _seeds(y)
    k = cut(G.best_reach(G.expand_paths(y, s, 2, 0.02)).select("build_id", "seed", "node").unionByName(s.withColumn("node", F.col("seed"))).distinct(), "inside")
    e = edges(spark, d).select("build_id", "a", "b")
    return e.join(k.select("build_id", "seed", F.col("node").alias("a")), ["build_id", "a"]).join(k.select("build_id", "seed", F.col("node").alias("b")), ["build_id", "seed", "b"]).select("build_id", "seed", "a", "b")


@CORE("n08_hop_candidates", sql=_WALK + ", c AS (SELECT build_id, seed, node, score, row_number() OVER (PARTITION BY build_id, seed ORDER BY round(score, 9) DESC, node) AS rank FROM bb WHERE r = 1) SELECT build_id, seed, node, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM c WHERE rank <= 150")
def n08(spark, d):
    """The 150 best candidates of each seed."""
    return top(_walk(spark, d).select("build_id", "seed", "node", "score"), ["build_id", "seed"], [F.round("score", 9).desc(), F.col("node")], 150).withColumn("score", F.round("score", 6))


@CORE("n09_beam_walk")
def n09(spark, d):
    """Best-first search of width 20 and three hops from each seed."""
    y = _sym(spark, d)
    return G.beam_walk(y, _seeds(y), 20, 3).withColumn("score", F.round("score", 6))


@CORE("n10_boltzmann_sample", sql=_WALK + ", u AS (SELECT build_id, seed, node, score, (CAST(('0x' || md5('g:' || build_id || ':' || seed || ':' || node)[1:12]) AS BIGINT) + 0.5) / 281474976710656.0 AS u FROM bb WHERE r = 1), g AS (SELECT *, row_number() OVER (PARTITION BY build_id, seed ORDER BY round(score / 0.3 - ln(-ln(u)), 9) DESC, node) AS draw FROM u) SELECT build_id, seed, node, CAST(draw AS INT) AS draw FROM g WHERE draw <= 5")
def n10(spark, d):
    """Five nodes of each neighbourhood drawn by score at temperature 0.3 (a sampling operator)."""
    return G.gumbel_sample(_walk(spark, d).select("build_id", "seed", "node", "score"), ["build_id", "seed"], "node", "score", 0.3, 5, "g").select("build_id", "seed", "node", "draw")


@CORE("n14_bridge_costs")
def n14(spark, d):
    """Least cost between the seeds of a build: the bridges among top nodes."""
    y = _sym(spark, d)
    s = _seeds(y)
    c = G.cheapest_paths(y, s, 0.1)
    return c.join(s.select("build_id", F.col("seed").alias("node")), ["build_id", "node"], "left_semi").filter("seed < node").select("build_id", "seed", "node", F.round("cost", 6).alias("cost"))


_U = "(CAST(('0x' || md5('{g}:' || build_id || ':' || seed || ':' || node)[1:12]) AS BIGINT) + 0.5) / 281474976710656.0"
_DRAWS = " UNION ALL ".join(f"SELECT build_id, seed, node, {i} AS draw FROM (SELECT build_id, seed, node, row_number() OVER (PARTITION BY build_id, seed ORDER BY round(score / 0.3 - ln(-ln({_U.format(g=f'd{i}')})), 9) DESC, node) AS r FROM bb WHERE r = 1) WHERE r <= 5" for i in range(3))


@CORE("n15_stability", sql=_WALK + f", t AS ({_DRAWS}), z AS (SELECT build_id, seed, draw, list(node) AS l FROM t GROUP BY ALL) SELECT x.build_id, x.seed, round(avg(len(list_intersect(x.l, z.l)) / len(list_distinct(list_concat(x.l, z.l)))), 6) AS stability FROM z x JOIN z ON z.build_id = x.build_id AND z.seed = x.seed AND x.draw < z.draw GROUP BY x.build_id, x.seed")
def n15(spark, d):
    """Stability of sampled neighbourhoods: mean Jaccard overlap of each two of three draws of five nodes."""
    w = cut(_walk(spark, d).select("build_id", "seed", "node", "score"), "walk")
    t = None
    for i in range(3):
        x = G.gumbel_sample(w, ["build_id", "seed"], "node", "score", 0.3, 5, f"d{i}").select("build_id", "seed", "node", F.lit(i).alias("draw"))
        t = x if t is None else t.unionByName(x)
    z = cut(t.groupBy("build_id", "seed", "draw").agg(F.collect_set("node").alias("l")), "draws")  # five nodes each
    y = z.select("build_id", "seed", F.col("draw").alias("draw2"), F.col("l").alias("l2"))
    j = z.join(y, ["build_id", "seed"]).filter("draw < draw2")
    return j.groupBy("build_id", "seed").agg(F.round(F.avg(F.size(F.array_intersect("l", "l2")) / F.size(F.array_union("l", "l2"))), 6).alias("stability"))


@CORE("n16_degrees", sql=_Y + " SELECT build_id, a AS id, count(*) AS degree, round(sum(s), 5) AS strength FROM y GROUP BY ALL")
def n16(spark, d):
    """Degree and strength of every node."""
    return _sym(spark, d).groupBy("build_id", F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("degree"), F.round(F.sum("s"), 5).alias("strength"))


@CORE("n17_degree_weighted_paths", sql=_Y + ", dg AS (SELECT build_id, a, CAST(count(*) AS DOUBLE) AS deg FROM y GROUP BY ALL), p AS (SELECT x.build_id, x.a, x.b AS via, z.b, pow(da.deg, -0.4) * pow(dv.deg, -0.4) * pow(db.deg, -0.4) AS w FROM y x JOIN y z ON z.build_id = x.build_id AND z.a = x.b AND x.a < z.b JOIN dg da ON da.build_id = x.build_id AND da.a = x.a JOIN dg dv ON dv.build_id = x.build_id AND dv.a = x.b JOIN dg db ON db.build_id = x.build_id AND db.a = z.b) SELECT build_id, a, b, count(*) AS paths, round(sum(w), 6) AS dwpc FROM p GROUP BY ALL")
def n17(spark, d):
    """Degree-weighted count of two-hop paths between nodes, every node on a path damped."""
    y = _sym(spark, d).select("build_id", "a", "b")
    deg = cut(y.groupBy("build_id", "a").agg(F.count(F.lit(1)).cast("double").alias("deg")), "deg")
    p = y.select("build_id", "a", F.col("b").alias("via")).join(y.select("build_id", F.col("a").alias("via"), "b"), ["build_id", "via"]).filter("a < b")
    for c in ("a", "via", "b"):
        p = p.join(deg.select("build_id", F.col("a").alias(c), F.pow("deg", F.lit(-0.4)).alias(f"w_{c}")), ["build_id", c])
    return p.groupBy("build_id", "a", "b").agg(F.count(F.lit(1)).alias("paths"), F.round(F.sum(F.col("w_a") * F.col("w_via") * F.col("w_b")), 6).alias("dwpc"))


@CORE("n18_cheapest_paths")
def n18(spark, d):
    """Least-cost paths from the seeds to all nodes."""
    y = _sym(spark, d)
    return G.cheapest_paths(y, _seeds(y), 0.1).withColumn("cost", F.round("cost", 6))


_PR = _Y + ", d AS (SELECT build_id, a AS id, sum(s) AS d FROM y GROUP BY ALL), n AS (SELECT build_id, count(*) AS n FROM d GROUP BY build_id), r0 AS (SELECT build_id, id, 1.0 / n AS r FROM d JOIN n USING (build_id))" + "".join(
    f", r{i + 1} AS (SELECT d.build_id, d.id, 0.15 / n + 0.85 * coalesce(g, 0) AS r FROM d JOIN n USING (build_id) LEFT JOIN (SELECT y.build_id, y.b AS id, sum(r * s / d) AS g FROM y JOIN r{i} ON r{i}.build_id = y.build_id AND r{i}.id = y.a JOIN d ON d.build_id = y.build_id AND d.id = y.a GROUP BY ALL) q ON q.build_id = d.build_id AND q.id = d.id)"
    for i in range(10))


@CORE("n19_pagerank", sql=_PR + " SELECT build_id, id, round(r, 6) AS rank FROM r10")
def n19(spark, d):
    """PageRank after ten rounds."""
    return G.pagerank(_sym(spark, d), 0.85, 10).withColumn("rank", F.round("rank", 6))


@CORE("n19_triangles", sql="WITH " + EDGES + ", t AS (SELECT x.build_id, x.a AS p, x.b AS q, z.b AS r FROM e x JOIN e z ON z.build_id = x.build_id AND z.a = x.b JOIN e w ON w.build_id = x.build_id AND w.a = x.a AND w.b = z.b) SELECT build_id, id, count(*) AS triangles FROM (SELECT build_id, unnest([p, q, r]) AS id FROM t) GROUP BY ALL")
def n19b(spark, d):
    """Triangles at every node."""
    return G.triangles(cut(edges(spark, d), "edges"))


@CORE("n19_betweenness")
def n19c(spark, d):
    """Shortest-path betweenness from every node of a build."""
    y = _sym(spark, d)
    return G.betweenness(y, y.select("build_id", F.col("a").alias("src")).distinct()).withColumn("score", F.round("score", 4))


@CORE("n20_personal_pagerank")
def n20(spark, d):
    """PageRank that restarts at the seeds."""
    y = _sym(spark, d)
    s = _seeds(y).select("build_id", F.col("seed").alias("id"), F.lit(0.2).alias("p"))
    return G.pagerank(y, 0.85, 15, s).withColumn("rank", F.round("rank", 6))


@CORE("n21_components", sql="WITH RECURSIVE " + SYM + ", w AS (SELECT build_id, a AS id, a AS c FROM y UNION SELECT y.build_id, y.b, w.c FROM w JOIN y ON y.build_id = w.build_id AND y.a = w.id AND w.c < y.b) SELECT build_id, id, min(c) AS component FROM w GROUP BY ALL")
def n21(spark, d):
    """Connected components of each build."""
    e = edges(spark, d)
    tag = lambda c: F.format_string("%d:%010d", "build_id", c)
    e = cut(e.select(tag("a").alias("a"), tag("b").alias("b")), "tagged")
    nodes = e.select(F.col("a").alias("id")).unionByName(e.select(F.col("b").alias("id"))).distinct()
    c = G.components(e, nodes)
    part = lambda x, i: F.split(x, ":")[i]
    return c.select(part("id", 0).cast("long").alias("build_id"), part("id", 1).cast("int").alias("id"), part("component", 1).cast("int").alias("component"))


@CORE("n22_diverse_set")
def n22(spark, d):
    """Nodes of each neighbourhood picked greedily so that no two are joined."""
    y = _sym(spark, d)
    reach = G.best_reach(G.expand_paths(y, _seeds(y), 2, 0.02)).select("build_id", "seed", "node", "score")
    return greedy_independent(reach, y)


@CORE("n24_section_neighbours", sql=MENTIONS + ", p AS (SELECT x.build_id, x.ord AS a, z.ord AS b, round(sum(ln(n.n / f.df)), 6) AS s FROM m x JOIN m z ON z.build_id = x.build_id AND z.entity_id = x.entity_id AND z.ord <> x.ord JOIN f ON f.build_id = x.build_id AND f.entity_id = x.entity_id JOIN n ON n.build_id = x.build_id WHERE f.df BETWEEN 2 AND 100 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY build_id, a ORDER BY s DESC, b) AS rank FROM p) SELECT build_id, a, b, s, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5")
def n24(spark, d):
    """The five sections that share most rare entities with each: by the sum of ln(N / df) over shared entities, of those in at
    most 100 sections of the build (the rule of entity bridges; a more frequent one joins no two sections)."""
    return top(_shared(spark, d), ["build_id", "a"], [F.col("s").desc(), F.col("b")], 5)


def _shared(spark, d):
    m = mentions(spark, d)
    f = m.groupBy("build_id", "entity_id").agg(F.count(F.lit(1)).alias("df"))
    n = m.groupBy("build_id").agg(F.countDistinct("ord").alias("n"))
    x = m.join(f.filter("df BETWEEN 2 AND 100"), ["build_id", "entity_id"]).join(n, "build_id").select("build_id", "entity_id", "ord", F.log(F.col("n") / F.col("df")).alias("w"))
    # the bridge rule: only an entity of at most a hundred sections joins two, so its pairs are bounded
    return x.withColumnRenamed("ord", "a").join(x.select("build_id", "entity_id", F.col("ord").alias("b")), ["build_id", "entity_id"]).filter("a <> b").groupBy("build_id", "a", "b").agg(F.round(F.sum("w"), 6).alias("s"))


@CORE("n25_rank_fusion", sql=MENTIONS + ", l1 AS (SELECT build_id, ord, row_number() OVER (PARTITION BY build_id ORDER BY sum(cnt) DESC, ord) AS r FROM m GROUP BY build_id, ord), l2 AS (SELECT build_id, ord, row_number() OVER (PARTITION BY build_id ORDER BY count(*) DESC, ord) AS r FROM m GROUP BY build_id, ord) SELECT build_id, ord, round(sum(1.0 / (60 + r)), 8) AS rrf FROM (SELECT * FROM l1 WHERE r <= 144 UNION ALL SELECT * FROM l2 WHERE r <= 144) GROUP BY ALL")
def n25(spark, d):
    """Reciprocal rank fusion of two lists of 144 sections of each build: by mentions, and by distinct entities."""
    from sectloom.operators.search import rank_fusion

    m = cut(mentions(spark, d).groupBy("build_id", "ord").agg(F.sum("cnt").alias("c"), F.count(F.lit(1)).alias("k")), "counts")
    return rank_fusion([top(m, ["build_id"], [F.col(c).desc(), F.col("ord")], 144) for c in ("c", "k")], "build_id", "ord")


_BRIDGES = MENTIONS + ", p AS (SELECT x.build_id, x.ord AS a, z.ord AS b, round(sum(ln(n.n / f.df)), 6) AS s FROM m x JOIN m z ON z.build_id = x.build_id AND z.entity_id = x.entity_id AND z.ord <> x.ord JOIN f ON f.build_id = x.build_id AND f.entity_id = x.entity_id JOIN n ON n.build_id = x.build_id WHERE f.df BETWEEN 2 AND 100 GROUP BY ALL), nb AS (SELECT build_id, a, b FROM (SELECT *, row_number() OVER (PARTITION BY build_id, a ORDER BY s DESC, b) AS r FROM p) WHERE r <= 5)"


@CORE("n27_shared_entities", sql=_BRIDGES + " SELECT build_id, a, b, entity_id, CAST(rank AS INT) AS rank FROM (SELECT nb.build_id, nb.a, nb.b, x.entity_id, row_number() OVER (PARTITION BY nb.build_id, nb.a, nb.b ORDER BY df, x.entity_id) AS rank FROM nb JOIN m x ON x.build_id = nb.build_id AND x.ord = nb.a JOIN m z ON z.build_id = nb.build_id AND z.ord = nb.b AND z.entity_id = x.entity_id JOIN f ON f.build_id = nb.build_id AND f.entity_id = x.entity_id WHERE df <= 100) WHERE rank <= 3")
def n27(spark, d):
    """Why two neighbouring sections are joined: the three rarest entities both name."""
    m = mentions(spark, d)
    f = m.groupBy("build_id", "entity_id").agg(F.count(F.lit(1)).alias("df")).filter("df <= 100")
    nb = cut(top(_shared(spark, d), ["build_id", "a"], [F.col("s").desc(), F.col("b")], 5).select("build_id", "a", "b"), "neighbours")
    x = m.join(f, ["build_id", "entity_id"]).select("build_id", "entity_id", "ord", "df")
    j = nb.join(x.withColumnRenamed("ord", "a"), ["build_id", "a"]).join(x.select("build_id", "entity_id", F.col("ord").alias("b")), ["build_id", "entity_id", "b"])
    return top(j, ["build_id", "a", "b"], [F.col("df"), F.col("entity_id")], 3).select("build_id", "a", "b", "entity_id", "rank")


@CORE("n29_weighted_sample", sql=f"WITH {_S}, z AS (SELECT build_id, cid, count(*) AS n FROM s GROUP BY ALL), u AS (SELECT *, (CAST(('0x' || md5('w:' || build_id || ':' || cid)[1:12]) AS BIGINT) + 0.5) / 281474976710656.0 AS u FROM z), r AS (SELECT *, row_number() OVER (PARTITION BY build_id ORDER BY round(ln(u) / sqrt(n), 9) DESC, cid) AS draw FROM u) SELECT build_id, cid, n, CAST(draw AS INT) AS draw FROM r WHERE draw <= 5")
def n29(spark, d):
    """Five communities of each build drawn with chances by the root of their size (a sampling operator)."""
    z = _members(spark, d).groupBy("build_id", "cid").agg(F.count(F.lit(1)).alias("n"))
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("w"), "build_id", "cid")), 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)
    w = Window.partitionBy("build_id").orderBy(F.round(F.log(u) / F.sqrt("n"), 9).desc(), "cid")
    return z.withColumn("draw", F.row_number().over(w)).filter("draw <= 5")


@CORE("n36_friends_of_friends", sql=_Y + " SELECT x.build_id, x.a, count(DISTINCT z.b) AS fof FROM y x JOIN y z ON z.build_id = x.build_id AND z.a = x.b AND z.b <> x.a GROUP BY ALL")
def n36(spark, d):
    """Distinct nodes two steps away."""
    y = _sym(spark, d).select("build_id", "a", "b")
    return y.select("build_id", "a", F.col("b").alias("via")).join(y.select("build_id", F.col("a").alias("via"), "b"), ["build_id", "via"]).filter("a <> b").groupBy("build_id", "a").agg(F.countDistinct("b").alias("fof"))


@CORE("c02_louvain")
def c02(spark, d):
    """Communities of the entity graph of each build."""
    return G.louvain(edges(spark, d), ["build_id"])


@CORE("c02_modularity")
def c02b(spark, d):
    """Modularity of those communities, and whether they cover every node once."""
    e = cut(edges(spark, d), "edges")
    m = cut(G.louvain(e, ["build_id"]), "members")
    n = symmetric(e).groupBy("build_id").agg(F.countDistinct("a").alias("nodes"))
    c = m.groupBy("build_id").agg(F.count(F.lit(1)).alias("labelled"), F.countDistinct("cid").alias("communities"))
    return G.modularity(e, m).join(n, "build_id").join(c, "build_id").select("build_id", F.round("q", 6).alias("q"), "communities", (F.col("nodes") == F.col("labelled")).alias("covers"))


_SWEEP = [0.5, 0.75, 1.0, 1.25, 1.5, 2.0]


@CORE("c03_consensus")
def c03(spark, d):
    """Consensus communities of the entity graph: together for at least half of five seeds."""
    return G.consensus(cut(edges(spark, d), "edges"), ["build_id"], [1, 2, 3, 4, 5])


def _sweep(spark, d):
    return G.seed_agreement(cut(edges(spark, d), "edges"), ["build_id"], _SWEEP, [1, 2, 3])


@CORE("c04_resolution_sweep")
def c04(spark, d):
    """Mean number of communities over three seeds at six resolutions, and how far the seeds agree."""
    return _sweep(spark, d).select("build_id", "resolution", F.round("communities", 4).alias("communities"), F.round("ari", 6).alias("ari"))


@CORE("c05_plateau_pick")
def c05(spark, d):
    """The resolution to serve of each build: on the longest flat stretch of seed agreement, nearest to as many communities as its
    sections carry. A sweep is six rows a build."""
    import pandas as pd

    want = _members(spark, d).groupBy("build_id").agg(F.countDistinct("cid").cast("double").alias("want"))

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        r = G.plateau(list(zip(pdf.resolution, pdf.communities, pdf.ari)), float(pdf.want.iloc[0]))
        return pd.DataFrame({"build_id": [pdf.build_id.iloc[0]], "resolution": [r], "want": [pdf.want.iloc[0]]})

    return _sweep(spark, d).join(want, "build_id").groupBy("build_id").applyInPandas(pick, "build_id long, resolution double, want double")


@CORE("c06_consensus_gate")
def c06(spark, d):
    """Three consensus runs of three seeds each: the communities of the first, their mean agreement, and whether it reaches 0.8."""
    e = cut(edges(spark, d), "edges")
    runs = None
    for k in range(3):
        c = G.consensus(e, ["build_id"], [10 * k + 1, 10 * k + 2, 10 * k + 3]).withColumn("run", F.lit(k))
        runs = c if runs is None else runs.unionByName(c)
    runs = cut(runs, "runs")
    y = runs.select("build_id", "id", F.col("run").alias("run2"), F.col("cid").alias("cid2"))
    a = G.adjusted_rand(runs.join(y, ["build_id", "id"]).filter("run < run2"), "cid", "cid2", ["build_id", "run", "run2"]).groupBy("build_id").agg(F.avg("ari").alias("ari"))
    n = runs.filter("run = 0").groupBy("build_id").agg(F.countDistinct("cid").alias("communities"))
    return n.join(a, "build_id").select("build_id", "communities", F.round("ari", 6).alias("ari"), (F.col("ari") >= 0.8).alias("passes"))


@CORE("c07_oversize_split")
def c07(spark, d):
    """Entity communities with more members than the root of the number of edges, divided inside their own graph where consensus
    runs agree; with the label before."""
    e = cut(edges(spark, d), "edges")
    return G.split_oversize(e, G.louvain(e, ["build_id"]), ["build_id"])


@CORE("c09_community_term_labels")
def c09(spark, d):
    """Eight characteristic terms of each community, none within another."""
    from sectloom.plans.q_stats import _community_table

    t = _community_table(spark, d).filter("a >= 3 AND a * n > r * c").select("cid", "term", F.round(stats.g2(F.col("a"), F.col("r"), F.col("c"), F.col("n")), 6).alias("g2"))
    return suppress_contained(top(t, ["cid"], [F.col("g2").desc(), F.col("term")], 200), "cid", "term", "g2", 8)


@CORE("c10_term_spread", sql=None)
def c10(spark, d):
    """The community each term is most typical of, and its evenness over communities."""
    from sectloom.plans.q_stats import _community_table

    t = cut(_community_table(spark, d), "table")
    k = t.select("cid").distinct().count()
    tot = t.groupBy("term").agg(F.sum("a").alias("t"))
    p = F.col("a") / F.col("t")
    g = F.round(stats.g2(F.col("a"), F.col("r"), F.col("c"), F.col("n")), 6)
    return t.withColumn("g", g).join(tot, "term").groupBy("term").agg(F.max_by("cid", F.struct("g", -F.col("cid"))).alias("cid"), F.round(-F.sum(p * F.log2(p)) / G.mutual_reach(max(2, k)), 6).alias("evenness"))


_CE = MENTIONS + f", {_S}, c AS (SELECT build_id, cid, CAST(count(*) AS DOUBLE) AS r FROM s GROUP BY ALL), t AS (SELECT build_id, CAST(count(*) AS DOUBLE) AS n FROM s GROUP BY ALL), o AS (SELECT build_id, cid, entity_id, CAST(count(*) AS DOUBLE) AS a FROM m JOIN s USING (build_id, ord) GROUP BY ALL), fd AS (SELECT build_id, entity_id, sum(a) AS c FROM o GROUP BY ALL) "


@CORE("c16_characteristic_entities", sql=_CE + ", g AS (SELECT build_id, cid, entity_id, CAST(a AS BIGINT) AS n_in, CAST(c AS BIGINT) AS n_all, round(2 * (a * ln(a * n / (r * c)) + CASE WHEN r - a > 0 THEN (r - a) * ln((r - a) * n / (r * (n - c))) ELSE 0 END + CASE WHEN c - a > 0 THEN (c - a) * ln((c - a) * n / ((n - r) * c)) ELSE 0 END + CASE WHEN n - r - c + a > 0 THEN (n - r - c + a) * ln((n - r - c + a) * n / ((n - r) * (n - c))) ELSE 0 END), 4) AS g2 FROM o JOIN (SELECT build_id, cid, r FROM c) USING (build_id, cid) JOIN fd USING (build_id, entity_id) JOIN t USING (build_id) WHERE a >= 3 AND a * n > r * fd.c), k AS (SELECT *, row_number() OVER (PARTITION BY build_id, cid ORDER BY g2 DESC, entity_id) AS rank FROM g) SELECT build_id, cid, entity_id, n_in, n_all, g2, CAST(rank AS INT) AS rank FROM k WHERE rank <= 8".replace("CAST(c AS BIGINT) AS n_all", "CAST(fd.c AS BIGINT) AS n_all"))
def c16(spark, d):
    """The eight entities most over-represented in each community."""
    s = cut(_members(spark, d), "members")
    o = mentions(spark, d).join(s, ["build_id", "ord"]).groupBy("build_id", "cid", "entity_id").agg(F.count(F.lit(1)).cast("double").alias("a"))
    f = o.groupBy("build_id", "entity_id").agg(F.sum("a").alias("c"))
    r = s.groupBy("build_id", "cid").agg(F.count(F.lit(1)).cast("double").alias("r"))
    n = s.groupBy("build_id").agg(F.count(F.lit(1)).cast("double").alias("n"))
    g = o.join(r, ["build_id", "cid"]).join(f, ["build_id", "entity_id"]).join(n, "build_id").filter("a >= 3 AND a * n > r * c")
    g = g.select("build_id", "cid", "entity_id", F.col("a").cast("long").alias("n_in"), F.col("c").cast("long").alias("n_all"), F.round(stats.g2(F.col("a"), F.col("r"), F.col("c"), F.col("n")), 4).alias("g2"))
    return top(g, ["build_id", "cid"], [F.col("g2").desc(), F.col("entity_id")], 8)


@CORE("c18_coverage", sql=MENTIONS + f", {_S} SELECT build_id, cid, count(DISTINCT ord) AS covered, CAST(sum(cnt) AS BIGINT) AS mentions, count(DISTINCT entity_id) AS entities FROM m JOIN s USING (build_id, ord) GROUP BY ALL")
def c18(spark, d):
    """Sections, mentions and entities of each community."""
    return mentions(spark, d).join(_members(spark, d), ["build_id", "ord"]).groupBy("build_id", "cid").agg(F.countDistinct("ord").alias("covered"), F.sum("cnt").alias("mentions"), F.countDistinct("entity_id").alias("entities"))


@CORE("c19_histogram", sql=f"WITH {_S}, c AS (SELECT build_id, cid, count(*) AS n FROM s GROUP BY ALL) SELECT build_id, cid, n, round(n / sum(n) OVER (PARTITION BY build_id), 6) AS share FROM c")
def c19(spark, d):
    """Size and share of each community."""
    c = _members(spark, d).groupBy("build_id", "cid").agg(F.count(F.lit(1)).alias("n"))
    return c.join(c.groupBy("build_id").agg(F.sum("n").alias("t")), "build_id").select("build_id", "cid", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))


_QG = MENTIONS + f", {_S}, h AS (SELECT build_id, entity_id, cid FROM (SELECT build_id, entity_id, cid, row_number() OVER (PARTITION BY build_id, entity_id ORDER BY count(*) DESC, cid) AS r FROM m JOIN s USING (build_id, ord) GROUP BY build_id, entity_id, cid) WHERE r = 1), {EDGES}, q AS (SELECT e.build_id, e.a, e.b, e.s, x.cid AS ca, z.cid AS cb FROM e JOIN h x ON x.build_id = e.build_id AND x.entity_id = a JOIN h z ON z.build_id = e.build_id AND z.entity_id = b)"


def _homed_edges(spark, d):
    """Edges with the home community of both ends: where most of an entity's sections are."""
    c = mentions(spark, d).join(_members(spark, d), ["build_id", "ord"]).groupBy("build_id", "entity_id", "cid").agg(F.count(F.lit(1)).alias("k"))
    h = cut(top(c, ["build_id", "entity_id"], [F.col("k").desc(), F.col("cid")], 1).select("build_id", "entity_id", "cid"), "home")
    return edges(spark, d).join(h.select("build_id", F.col("entity_id").alias("a"), F.col("cid").alias("ca")), ["build_id", "a"]).join(h.select("build_id", F.col("entity_id").alias("b"), F.col("cid").alias("cb")), ["build_id", "b"])


@CORE("c20_quotient_graph", sql=_QG + " SELECT build_id, least(ca, cb) AS ca, greatest(ca, cb) AS cb, count(*) AS n, round(avg(s), 6) AS mean FROM q WHERE ca <> cb GROUP BY build_id, least(ca, cb), greatest(ca, cb)")
def c20(spark, d):
    """Edges between communities."""
    return _homed_edges(spark, d).filter("ca <> cb").groupBy("build_id", F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("s"), 6).alias("mean"))


@CORE("c21_bridges", sql=_QG + ", r AS (SELECT build_id, least(ca, cb) AS x, greatest(ca, cb) AS y, a, b, round(s, 6) AS s, row_number() OVER (PARTITION BY build_id, least(ca, cb), greatest(ca, cb) ORDER BY s DESC, a, b) AS rank FROM q WHERE ca <> cb) SELECT build_id, x, y, a, b, s, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3")
def c21(spark, d):
    """The three strongest edges between each two communities."""
    q = _homed_edges(spark, d).filter("ca <> cb").select("build_id", F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y"), "a", "b", "s")
    return top(q, ["build_id", "x", "y"], [F.col("s").desc(), F.col("a"), F.col("b")], 3).withColumn("s", F.round("s", 6))


@CORE("c24_conductance", sql=_QG + ", u AS (SELECT build_id, ca AS cid, s, ca <> cb AS x FROM q UNION ALL SELECT build_id, cb, s, ca <> cb FROM q) SELECT build_id, cid, count(*) AS ends, round(sum(CASE WHEN x THEN s ELSE 0 END) / sum(s), 6) AS conductance FROM u GROUP BY ALL")
def c24(spark, d):
    """Share of each community's edge weight that leaves it."""
    q = _homed_edges(spark, d).withColumn("x", F.col("ca") != F.col("cb"))
    u = q.select("build_id", F.col("ca").alias("cid"), "s", "x").unionByName(q.select("build_id", F.col("cb").alias("cid"), "s", "x"))
    return u.groupBy("build_id", "cid").agg(F.count(F.lit(1)).alias("ends"), F.round(F.sum(F.when(F.col("x"), F.col("s")).otherwise(0.0)) / F.sum("s"), 6).alias("conductance"))


@CORE("c13_exemplars")
def c13(spark, d):
    """Exemplars of each label: the medoid, then rows that are like the label and unlike those chosen."""
    e = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    return exemplars(e, "vec_id", "label", "embedding", 3)


@CORE("c17_entity_composition", sql=MENTIONS + f", {_S}, nn AS (SELECT build_id, count(*) AS n FROM sect_node GROUP BY build_id), k AS (SELECT build_id, cid, entity_id, count(*) AS n_in FROM m JOIN s USING (build_id, ord) GROUP BY ALL), r AS (SELECT build_id, cid, entity_id, n_in, round(n_in * ln(nn.n / df), 6) AS score FROM k JOIN f USING (build_id, entity_id) JOIN nn USING (build_id) WHERE df <= 2000) SELECT build_id, cid, entity_id, n_in, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY build_id, cid ORDER BY score DESC, entity_id) AS rank FROM r) WHERE rank <= 6")
def c17(spark, d):
    """The six entities that most characterise each community's sections, by sections times ln(N / df), of those in at most 2,000
    sections. Entities are numbers in these tables; where they have names, ``distinct_surfaces`` drops one within another."""
    m = mentions(spark, d)
    f = m.groupBy("build_id", "entity_id").agg(F.count(F.lit(1)).alias("df")).filter("df <= 2000")
    n = sections(spark, d).groupBy("build_id").agg(F.count(F.lit(1)).alias("n"))
    k = m.join(_members(spark, d), ["build_id", "ord"]).groupBy("build_id", "cid", "entity_id").agg(F.count(F.lit(1)).alias("n_in"))
    x = k.join(f, ["build_id", "entity_id"]).join(n, "build_id").select("build_id", "cid", "entity_id", "n_in", F.round(F.col("n_in") * F.log(F.col("n") / F.col("df")), 6).alias("score"))
    return top(x, ["build_id", "cid"], [F.col("score").desc(), F.col("entity_id")], 6)


@CORE("c15_paper_spread", sql="WITH p AS (SELECT build_id, community AS cid, doc_id, count(*) AS k FROM sect_node WHERE community >= 0 GROUP BY ALL) SELECT build_id, cid, CAST(sum(k) AS BIGINT) AS size, count(*) AS papers, min_by(doc_id, (-k, doc_id)) AS top_paper, round(max(k) / sum(k), 6) AS top_share FROM p GROUP BY build_id, cid")
def c15(spark, d):
    """How each community spreads over papers: how many, and the one that holds most of it."""
    p = sections(spark, d).filter("community >= 0").groupBy("build_id", F.col("community").alias("cid"), "doc_id").agg(F.count(F.lit(1)).alias("k"))
    return p.groupBy("build_id", "cid").agg(F.sum("k").alias("size"), F.count(F.lit(1)).alias("papers"), F.min_by("doc_id", F.struct(-F.col("k"), "doc_id")).alias("top_paper"), F.round(F.max("k") / F.sum("k"), 6).alias("top_share"))


@CORE("c22_cross_community", sql=_QG + ", u AS (SELECT build_id, a AS id, ca AS cid, cb AS other FROM q WHERE ca <> cb UNION ALL SELECT build_id, b, cb, ca FROM q WHERE ca <> cb) SELECT build_id, id, cid, count(DISTINCT other) AS foreign_communities, count(*) AS foreign_edges FROM u GROUP BY ALL")
def c22(spark, d):
    """Entities with edges into other communities than their own: how many communities and edges."""
    q = _homed_edges(spark, d).filter("ca <> cb")
    u = q.select("build_id", F.col("a").alias("id"), F.col("ca").alias("cid"), F.col("cb").alias("other")).unionByName(q.select("build_id", F.col("b").alias("id"), F.col("cb").alias("cid"), F.col("ca").alias("other")))
    return u.groupBy("build_id", "id", "cid").agg(F.countDistinct("other").alias("foreign_communities"), F.count(F.lit(1)).alias("foreign_edges"))


_MED = _WALK + ", wt AS (SELECT build_id, seed, node, score FROM bb WHERE r = 1), cc AS (SELECT x.build_id, x.seed, x.node, round(x.score * sum(z.score * y.s), 9) AS c FROM wt x JOIN y ON y.build_id = x.build_id AND y.a = x.node JOIN wt z ON z.build_id = x.build_id AND z.seed = x.seed AND z.node = y.b GROUP BY x.build_id, x.seed, x.node, x.score)"


@CORE("c23_local_medoid", sql=_MED + " SELECT build_id, seed, min_by(node, (-c, node)) AS medoid, round(max(c), 6) AS centrality FROM cc GROUP BY build_id, seed")
def c23(spark, d):
    """The node most central to what each walk found: its score times the summed score and strength of its neighbours in the walk."""
    y = _sym(spark, d)
    w = cut(G.best_reach(G.expand_paths(y, _seeds(y), 2, 0.02)).select("build_id", "seed", "node", "score"), "walk")
    z = w.select("build_id", "seed", F.col("node").alias("b"), F.col("score").alias("sb"))
    c = w.join(y.withColumnRenamed("a", "node"), ["build_id", "node"]).join(z, ["build_id", "seed", "b"]).groupBy("build_id", "seed", "node", "score").agg(F.sum(F.col("sb") * F.col("s")).alias("t"))
    c = c.select("build_id", "seed", "node", F.round(F.col("score") * F.col("t"), 9).alias("c"))
    return c.groupBy("build_id", "seed").agg(F.min_by("node", F.struct(-F.col("c"), "node")).alias("medoid"), F.round(F.max("c"), 6).alias("centrality"))


@CORE("c25_catalogue", sql="WITH t AS (SELECT build_id, community AS cid, section_title AS title, count(*) AS k FROM sect_node WHERE community >= 0 GROUP BY ALL), z AS (SELECT build_id, cid, CAST(sum(k) AS BIGINT) AS size, min_by(title, (-k, title)) FILTER (title IS NOT NULL) AS title FROM t GROUP BY build_id, cid HAVING sum(k) > 1) SELECT build_id, cid, size, title, CAST(row_number() OVER (PARTITION BY build_id ORDER BY size DESC, cid) AS INT) AS rank FROM z")
def c25(spark, d):
    """Communities of more than one section, largest first, with their commonest section title."""
    t = sections(spark, d).filter("community >= 0").groupBy("build_id", F.col("community").alias("cid"), F.col("section_title").alias("title")).agg(F.count(F.lit(1)).alias("k"))
    best = F.min_by("title", F.when(F.col("title").isNotNull(), F.struct(-F.col("k"), "title")))
    z = t.groupBy("build_id", "cid").agg(F.sum("k").alias("size"), best.alias("title")).filter("size > 1")
    return top(z, ["build_id"], [F.col("size").desc(), F.col("cid")], 1 << 30)


@CORE("c28_subgraph_communities")
def c28(spark, d):
    """Communities of each seed's neighbourhood alone; they are shown, never stored. Nodes no edge joins are their own."""
    y = _sym(spark, d)
    s = _seeds(y)
    k = cut(G.best_reach(G.expand_paths(y, s, 2, 0.02)).select("build_id", "seed", "node").unionByName(s.withColumn("node", F.col("seed"))).distinct(), "inside")
    e = edges(spark, d).join(k.select("build_id", "seed", F.col("node").alias("a")), ["build_id", "a"]).join(k.select("build_id", "seed", F.col("node").alias("b")), ["build_id", "seed", "b"])
    g = cut(G.louvain(e.select("build_id", "seed", "a", "b", "s"), ["build_id", "seed"]), "parts")
    alone = k.select("build_id", "seed", F.col("node").cast("long").alias("id")).join(g.select("build_id", "seed", "id"), ["build_id", "seed", "id"], "left_anti")
    return g.unionByName(alone.withColumn("cid", F.col("id")))


@CORE("c26_scorecard", sql=f"WITH {_S}, c AS (SELECT build_id, cid, count(*) AS n FROM s GROUP BY ALL), p AS (SELECT build_id, cid, max(k) AS top FROM (SELECT s.build_id, s.cid, doc_id, count(*) AS k FROM s JOIN sect_node USING (build_id, ord) GROUP BY ALL) GROUP BY ALL), t AS (SELECT build_id, sum(n) AS t FROM c GROUP BY build_id) SELECT build_id, count(*) AS communities, max(n) AS largest, round(sum(CASE WHEN n > sqrt(t) THEN n ELSE 0 END) / any_value(t), 6) AS oversize_share, median(top / n) AS top_paper FROM c JOIN p USING (build_id, cid) JOIN t USING (build_id) GROUP BY build_id")
def c26(spark, d):
    """Communities of a build: sizes, share in oversized ones, median share of the top paper."""
    s = _members(spark, d).join(sections(spark, d).select("build_id", "ord", "doc_id"), ["build_id", "ord"])
    c = s.groupBy("build_id", "cid").agg(F.count(F.lit(1)).alias("n"))
    p = s.groupBy("build_id", "cid", "doc_id").agg(F.count(F.lit(1)).alias("k")).groupBy("build_id", "cid").agg(F.max("k").alias("top"))
    t = c.groupBy("build_id").agg(F.sum("n").alias("t"))
    j = c.join(p, ["build_id", "cid"]).join(t, "build_id")
    return j.groupBy("build_id").agg(F.count(F.lit(1)).alias("communities"), F.max("n").alias("largest"), F.round(F.sum(F.when(F.col("n") > F.sqrt("t"), F.col("n")).otherwise(0)) / F.first("t"), 6).alias("oversize_share"), F.median(F.col("top") / F.col("n")).alias("top_paper"))


@CORE("c27_heading_share", sql=r"""WITH k AS (SELECT community AS cid, trim(regexp_replace(lower(regexp_replace(section_title, '^\s*(?:[A-Za-z]\.|\d+(?:\.\d+)*\.?|[IVX]+\.)?\s*', '')), '[^a-z ]', '', 'g'), ' ') AS kind FROM sect_node WHERE section_title IS NOT NULL AND community >= 0), c AS (SELECT cid, kind, count(*) AS n FROM k GROUP BY ALL) SELECT cid, round(max(n) / sum(n), 6) AS top_heading FROM c GROUP BY cid""")
def c27(spark, d):
    """Share of the commonest heading in each community."""
    from sectloom.functions.text import heading_kind

    c = sections(spark, d).filter("section_title IS NOT NULL AND community >= 0").groupBy(F.col("community").alias("cid"), heading_kind(F.col("section_title")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("cid").agg(F.round(F.max("n") / F.sum("n"), 6).alias("top_heading"))


@CORE("c29_lift", sql=MENTIONS + f", {_S}, g AS (SELECT build_id, cid, entity_id, sum(cnt) AS k FROM m JOIN s USING (build_id, ord) GROUP BY ALL), gt AS (SELECT build_id, cid, sum(k) AS t FROM g GROUP BY ALL), al AS (SELECT build_id, entity_id, sum(k) AS a FROM g GROUP BY ALL), tt AS (SELECT build_id, sum(k) AS n FROM g GROUP BY ALL) SELECT build_id, cid, entity_id, round((k / t) / (a / n), 6) AS lift FROM g JOIN gt USING (build_id, cid) JOIN al USING (build_id, entity_id) JOIN tt USING (build_id) WHERE k >= 2")
def c29(spark, d):
    """Share of an entity in a community's mentions over its share in all."""
    g = mentions(spark, d).join(_members(spark, d), ["build_id", "ord"]).groupBy("build_id", "cid", "entity_id").agg(F.sum("cnt").alias("k"))
    g = cut(g, "mass")
    j = g.join(g.groupBy("build_id", "cid").agg(F.sum("k").alias("t")), ["build_id", "cid"]).join(g.groupBy("build_id", "entity_id").agg(F.sum("k").alias("a")), ["build_id", "entity_id"]).join(g.groupBy("build_id").agg(F.sum("k").alias("n")), "build_id")
    return j.filter("k >= 2").select("build_id", "cid", "entity_id", F.round((F.col("k") / F.col("t")) / (F.col("a") / F.col("n")), 6).alias("lift"))
