"""Searches composed of parts: N05, N11-N13, N26-N28, N30-N35."""

from __future__ import annotations

from pyspark.sql import functions as F

from sectloom.functions import stats
from sectloom.functions.text import tokenize
from sectloom.operators import dense as D
from sectloom.operators import lexical as L
from sectloom.operators import search as S
from sectloom.operators.lexical import top
from sectloom.plans.base import mentions, sections
from sectloom.plans.q_graph import _SEED, _seeds, _shared, _sym
from sectloom.plans.q_lexical import _SEARCH
from sectloom.plans.q_stats import _CT, _G2, _community_table
from sectloom.plans.registry import CORE
from sectloom.plans.runtime import cut, table
from sectloom.plans.sqlparts import MENTIONS, POST, QUERY, tokens

_DPOST = POST.replace("record_id", "doc_id").replace("sect_node", "documents")
_DHIT = _DPOST + f", {QUERY}, h AS (SELECT item_id, doc_id, any_value(source) AS source, round(sum(w), 6) AS score FROM q JOIN wt USING (term) JOIN documents USING (doc_id) GROUP BY ALL), hh AS (SELECT item_id, doc_id, source, score FROM h) "


def _items(spark, d):
    return table(spark, d, "eval_item").select("item_id", F.explode(F.array_distinct(tokenize(F.col("text")))).alias("term"))


def _doc_hits(spark, d):
    """BM25 hits of every test item among the documents, with the document's source; and the documents' postings."""
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    p = cut(L.postings(docs, "doc_id", "text"), "postings")
    w = L.weights(p, "doc_id").select("doc_id", "term", "w")
    h = _items(spark, d).join(w, "term").groupBy("item_id", "doc_id").agg(F.round(F.sum("w"), 6).alias("score"))
    return h.join(docs.select("doc_id", "source"), "doc_id"), p.join(docs.select("doc_id", "source"), "doc_id")


_ANCHOR = _DHIT + """, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM hh) WHERE r <= 3), lo AS (SELECT item_id, min(score) AS low, count(*) AS n FROM b GROUP BY item_id),
x AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, source ORDER BY score DESC, doc_id) AS r FROM hh WHERE source IS NOT NULL) WHERE r = 1),
ex AS (SELECT x.item_id, x.doc_id, x.source, x.score, n, row_number() OVER (PARTITION BY x.item_id ORDER BY x.score DESC, x.doc_id) AS k FROM x JOIN lo USING (item_id) WHERE x.score >= 0.5 * low AND NOT EXISTS (SELECT 1 FROM b WHERE b.item_id = x.item_id AND b.source = x.source)) """


@CORE("n11_anchors", sql=_ANCHOR + "SELECT item_id, doc_id, source, score, false AS extra FROM b UNION ALL SELECT item_id, doc_id, source, score, true FROM ex WHERE k <= 8 - n")
def n11(spark, d):
    """Three anchors of every test item among the documents, and a competitive extra of each source they miss, eight in all."""
    return S.anchors(cut(_doc_hits(spark, d)[0], "hits"), "item_id", "doc_id", 3, 8)


_ROUTER = _DPOST + f""", {QUERY}, so AS (SELECT source, term, CAST(sum(tf) AS DOUBLE) AS occ FROM post JOIN documents USING (doc_id) GROUP BY ALL), sz AS (SELECT source, sum(occ) AS size FROM so WHERE source IS NOT NULL GROUP BY source), tt AS (SELECT sum(size) AS total FROM sz),
ev AS (SELECT term, sum(CASE WHEN source IS NOT NULL THEN occ ELSE 0 END) AS al FROM so GROUP BY term), lo AS (SELECT item_id, sz.source, avg(ln(((coalesce(occ, 0) + 0.5) / (size + 0.5)) / greatest((CASE WHEN al > 0 THEN al ELSE 1 END) / total, 1e-12))) AS lo FROM q JOIN ev USING (term) CROSS JOIN sz CROSS JOIN tt LEFT JOIN so ON so.source = sz.source AND so.term = q.term GROUP BY ALL),
ee AS (SELECT *, exp((lo - max(lo) OVER (PARTITION BY item_id)) / 0.2) AS e FROM lo), rw AS (SELECT item_id, source, e / sum(e) OVER (PARTITION BY item_id) AS weight FROM ee) """


@CORE("n12_router", sql=_ROUTER + "SELECT item_id, source, round(weight, 6) AS weight FROM rw")
def n12(spark, d):
    """The sources each test item speaks like."""
    _, p = _doc_hits(spark, d)
    return S.router(_items(spark, d), p, "item_id").withColumn("weight", F.round("weight", 6))


_QUOTA = _ROUTER + """, mx AS (SELECT item_id, source, greatest(CAST(round(round(1000 * greatest(weight, 0.05) / sum(greatest(weight, 0.05)) OVER (PARTITION BY item_id), 9)) AS BIGINT), 1) AS mix FROM rw), qx AS (SELECT *, 24 * mix / sum(mix) OVER (PARTITION BY item_id) AS exact FROM mx),
qt AS (SELECT item_id, source, mix, CAST(floor(exact) + CASE WHEN row_number() OVER (PARTITION BY item_id ORDER BY round(exact - floor(exact), 9) DESC, mix DESC, source) <= 24 - sum(floor(exact)) OVER (PARTITION BY item_id) THEN 1 ELSE 0 END AS BIGINT) AS quota FROM qx) """


@CORE("n13_router_quotas", sql=_QUOTA + "SELECT item_id, source, mix, quota FROM qt")
def n13(spark, d):
    """A budget of 24 places split by the router's weights."""
    _, p = _doc_hits(spark, d)
    return S.quotas(S.router(_items(spark, d), p, "item_id"), "item_id", 24)


@CORE("n13_ring", sql=_QUOTA + """, h AS (SELECT item_id, doc_id, any_value(source) AS source, round(sum(w), 6) AS score FROM q JOIN wt USING (term) JOIN documents USING (doc_id) GROUP BY ALL), c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM h) WHERE r <= 64),
du AS (SELECT c.item_id, c.doc_id, c.source, c.score, coalesce(row_number() OVER (PARTITION BY c.item_id, c.source ORDER BY c.score DESC, c.doc_id) <= quota, false) AS due FROM c LEFT JOIN qt ON qt.item_id = c.item_id AND qt.source = c.source)
SELECT item_id, doc_id, source, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY due DESC, score DESC, doc_id) AS r FROM du) WHERE r <= 24""")
def n13b(spark, d):
    """The 24 documents around each test item, by the quotas of their sources, from its 64 best hits."""
    h, p = _doc_hits(spark, d)
    c = cut(top(h, ["item_id"], [F.col("score").desc(), F.col("doc_id")], 64).drop("rank"), "candidates")
    return S.ring(c, S.quotas(S.router(_items(spark, d), p, "item_id"), "item_id", 24), "item_id", "doc_id", 24)


_V = "v AS (SELECT record_id, min(list_transform(emb, lambda x: CAST(x AS DOUBLE))) AS v FROM sect_embedding WHERE len(emb) = 256 AND len(list_filter(emb, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(emb, lambda x: x <> 0)) > 0 GROUP BY record_id), un AS (SELECT record_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM v)"
_ARM = ", dn AS (SELECT q.record_id AS query, e.record_id, round(list_inner_product(q.v, e.v), 6) AS s FROM un q JOIN un e ON q.record_id % 100 = 0 AND q.record_id <> e.record_id), da AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, record_id) AS rank FROM dn) WHERE rank <= {k})"


def _unit_vectors(spark, d):
    """(record_id, v): usable section vectors at unit length, once each."""
    ok = "size(emb) = 256 AND NOT exists(emb, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity')) AND exists(emb, x -> x <> 0)"
    v = table(spark, d, "sect_embedding").filter(ok).groupBy("record_id").agg(F.min(F.transform("emb", lambda x: x.cast("double"))).alias("v"))
    n = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return v.withColumn("_n", n).select("record_id", F.transform("v", lambda x: x / F.col("_n")).alias("v"))


def _dense_arm(spark, d, k):
    e = cut(_unit_vectors(spark, d), "unit")
    return D.block_topk(e, e.filter("record_id % 100 = 0"), "record_id", "v", k)


_SPARSE = f", qt0 AS (SELECT record_id AS query, unnest({tokens('section_title')}) AS term FROM sect_node WHERE record_id % 100 = 0 AND section_title IS NOT NULL), qt AS (SELECT DISTINCT query, term FROM qt0), sh AS (SELECT query, record_id, round(sum(w), 6) AS s FROM qt JOIN wt USING (term) WHERE record_id <> query GROUP BY ALL), sa AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, record_id) AS rank FROM sh) WHERE rank <= 144)"
_HYBRID = _CT + ", " + _V + _ARM.format(k=144) + _SPARSE + ", fu AS (SELECT query, record_id, round(sum(1.0 / (60 + rank)), 8) AS rrf FROM (SELECT query, record_id, rank FROM da UNION ALL SELECT query, record_id, rank FROM sa) GROUP BY ALL)"


def _hybrid(spark, d):
    """(query, record_id, rrf) of two arms for every section whose id is divisible by 100: its vector against all vectors, its
    title's terms against all sections; and those terms."""
    terms = sections(spark, d).filter("record_id % 100 = 0 AND section_title IS NOT NULL").select(F.col("record_id").alias("query"), F.explode(F.array_distinct(tokenize(F.col("section_title")))).alias("term"))
    terms = cut(terms, "terms")
    w = L.weights(L.postings(sections(spark, d), "record_id", "text"), "record_id")
    h = terms.join(w.select("record_id", "term", "w"), "term").filter("record_id <> query").groupBy("query", "record_id").agg(F.round(F.sum("w"), 6).alias("s"))
    sparse = top(h, ["query"], [F.col("s").desc(), F.col("record_id")], 144)
    return S.rank_fusion([_dense_arm(spark, d, 144), sparse], "query", "record_id"), terms


@CORE("n31_hybrid_search", sql=_HYBRID + "SELECT query, record_id, rrf, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rrf DESC, record_id) AS rank FROM fu) WHERE rank <= 10")
def n31(spark, d):
    """The ten best sections by both arms, fused by rank."""
    return top(_hybrid(spark, d)[0], ["query"], [F.col("rrf").desc(), F.col("record_id")], 10)


_AFF = _HYBRID + f""", gg AS (SELECT cid, term, round({_G2}, 6) AS g2 FROM g WHERE a * n > r * c AND round({_G2}, 6) >= 10.83), mo AS (SELECT term, max(g2) AS most FROM gg GROUP BY term), kn AS (SELECT query, qt.term, most FROM qt JOIN mo USING (term)), kc AS (SELECT query, count(*) AS n FROM kn GROUP BY query),
af AS (SELECT query, cid, sum(g2 / most) / any_value(kc.n) AS affinity FROM kn JOIN gg USING (term) JOIN kc USING (query) GROUP BY ALL),
ad AS (SELECT fu.query, fu.record_id, rrf, round(coalesce(affinity, 0), 6) AS affinity, round(rrf * (1 + 0.25 * coalesce(affinity, 0)), 8) AS score FROM fu LEFT JOIN s ON s.record_id = fu.record_id LEFT JOIN af ON af.query = fu.query AND af.cid = s.cid) """


@CORE("n30_affinity_boost", sql=_AFF + "SELECT query, record_id, rrf, affinity, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, record_id) AS rank FROM ad) WHERE rank <= 10")
def n30(spark, d):
    """The same lists with sections of communities that the title's terms are typical of raised by up to a quarter."""
    fused, terms = _hybrid(spark, d)
    g2 = F.round(stats.g2(F.col("a"), F.col("r"), F.col("c"), F.col("n")), 6)
    gate = _community_table(spark, d).filter("a * n > r * c").select("cid", "term", g2.alias("g2")).filter("g2 >= 10.83")
    aff = S.term_affinity(terms, cut(gate, "gate"), "query")
    s = sections(spark, d).filter("community IS NOT NULL AND community >= 0").select("record_id", F.col("community").alias("cid"))
    x = fused.join(s, "record_id", "left").join(aff, ["query", "cid"], "left").withColumn("affinity", F.coalesce("affinity", F.lit(0.0)))
    x = x.select("query", "record_id", "rrf", F.round("affinity", 6).alias("affinity"), F.round(F.col("rrf") * (1 + 0.25 * F.col("affinity")), 8).alias("score"))
    return top(x, ["query"], [F.col("score").desc(), F.col("record_id")], 10)


@CORE("n33_passing_communities", sql="WITH " + _V + _ARM.format(k=20) + ", pc AS (SELECT query, community AS cid, max(s) AS best FROM da JOIN sect_node USING (record_id) WHERE community >= 0 AND s >= 0.3 GROUP BY ALL) SELECT query, cid, best, CAST(row_number() OVER (PARTITION BY query ORDER BY best DESC, cid) AS INT) AS rank FROM pc")
def n33(spark, d):
    """Communities of which one of a query's 20 nearest sections reaches a similarity of 0.3, the best first; a query without is rejected."""
    a = _dense_arm(spark, d, 20).filter("s >= 0.3").join(sections(spark, d).filter("community >= 0").select("record_id", F.col("community").alias("cid")), "record_id")
    b = a.groupBy("query", "cid").agg(F.max("s").alias("best"))
    return top(b, ["query"], [F.col("best").desc(), F.col("cid")], 1 << 30)


_BRIDGE = MENTIONS + ", p AS (SELECT x.build_id, x.ord AS a, z.ord AS b, round(sum(ln(n.n / f.df)), 6) AS s FROM m x JOIN m z ON z.build_id = x.build_id AND z.entity_id = x.entity_id AND z.ord <> x.ord JOIN f ON f.build_id = x.build_id AND f.entity_id = x.entity_id JOIN n ON n.build_id = x.build_id WHERE f.df BETWEEN 2 AND 100 GROUP BY ALL)"


@CORE("n05_anchors_one_hop", sql=_BRIDGE + ", " + _V + _ARM.format(k=5) + """, nd AS (SELECT record_id, build_id, ord FROM sect_node), nb AS (SELECT query, t.record_id, da.s * p.s / (p.s + 10) AS s FROM da JOIN nd USING (record_id) JOIN p ON p.build_id = nd.build_id AND p.a = nd.ord JOIN nd t ON t.build_id = p.build_id AND t.ord = p.b WHERE t.record_id <> query)
SELECT query, record_id, round(max(s), 6) AS score, CAST(min(hop) AS INT) AS hop FROM (SELECT query, record_id, s, 0 AS hop FROM da UNION ALL SELECT query, record_id, s, 1 FROM nb) GROUP BY ALL""")
def n05(spark, d):
    """A query's five nearest sections and what shares rare entities with them, one hop out, with the better of the scores."""
    a = cut(_dense_arm(spark, d, 5).select("query", "record_id", "s"), "anchors")
    n = sections(spark, d).select("record_id", "build_id", "ord")
    p = _shared(spark, d)
    nb = a.join(n, "record_id").select("query", "build_id", F.col("ord").alias("a"), F.col("s").alias("s0")).join(p, ["build_id", "a"]).join(n.select("build_id", F.col("ord").alias("b"), "record_id"), ["build_id", "b"]).filter("record_id <> query")
    nb = nb.select("query", "record_id", (F.col("s0") * F.col("s") / (F.col("s") + 10)).alias("s"), F.lit(1).alias("hop"))
    return a.withColumn("hop", F.lit(0)).unionByName(nb).groupBy("query", "record_id").agg(F.round(F.max("s"), 6).alias("score"), F.min("hop").alias("hop"))


_HOPS = _SEED + ", s0 AS (SELECT build_id, seed AS node FROM sd)"
for _i in (1, 2):
    _HOPS += f""", l{_i} AS (SELECT * FROM (SELECT y.build_id, y.a, y.b, y.s, row_number() OVER (PARTITION BY y.build_id, y.a ORDER BY y.s DESC, y.b) AS r FROM y JOIN {'s0' if _i == 1 else 'k1'} f ON f.build_id = y.build_id AND f.node = y.a WHERE NOT EXISTS (SELECT 1 FROM ({' UNION ALL '.join(f'SELECT build_id, node FROM {t}' for t in ('s0', 'k1')[:_i])}) z WHERE z.build_id = y.build_id AND z.node = y.b)) WHERE r <= 5),
k{_i} AS (SELECT build_id, node, {_i} AS hop, weight FROM (SELECT *, row_number() OVER (PARTITION BY build_id ORDER BY rrf DESC, node) AS r FROM (SELECT build_id, b AS node, round(sum(1.0 / (60 + r)), 8) AS rrf, max(s) AS weight FROM l{_i} GROUP BY build_id, b)) WHERE r <= 12)"""


@CORE("n26_hop_pool", sql=_HOPS + " SELECT build_id, node, hop, round(weight, 6) AS weight FROM k1 UNION ALL SELECT build_id, node, hop, round(weight, 6) FROM k2")
def n26(spark, d):
    """Twelve nodes a hop around each build's seeds, two hops, ranked by fusion of the front's lists."""
    y = _sym(spark, d)
    return S.hop_pool(y, _seeds(y).withColumnRenamed("seed", "node"), ["build_id"], 2, 5, 12).withColumn("weight", F.round("weight", 6))


_EHOP = MENTIONS + ", nn AS (SELECT build_id, count(*) AS n FROM sect_node GROUP BY build_id), mm AS (SELECT m.build_id, ord, entity_id, ln(nn.n / df) AS w FROM m JOIN f USING (build_id, entity_id) JOIN nn USING (build_id) WHERE df <= 100), k0 AS (SELECT build_id, ord FROM sect_node WHERE ord % 100 = 0)"
for _i in (1, 2, 3):
    _EHOP += f", k{_i} AS (SELECT build_id, ord, {_i} AS hop, score, shared FROM (SELECT *, row_number() OVER (PARTITION BY build_id ORDER BY score DESC, ord) AS r FROM (SELECT build_id, ord, round(sum(w), 6) AS score, count(*) AS shared FROM mm WHERE (build_id, entity_id) IN (SELECT build_id, entity_id FROM mm JOIN k{_i - 1} USING (build_id, ord)) AND (build_id, ord) NOT IN ({' UNION ALL '.join(f'SELECT build_id, ord FROM k{j}' for j in range(_i))}) GROUP BY build_id, ord)) WHERE r <= 30)"


@CORE("n27_entity_walk", sql=_EHOP + " SELECT * FROM k1 UNION ALL SELECT * FROM k2 UNION ALL SELECT * FROM k3")
def n27b(spark, d):
    """Sections reached from every hundredth section of a build over rare entities, 30 a hop, three hops."""
    return S.entity_hops(mentions(spark, d), sections(spark, d), sections(spark, d).filter("ord % 100 = 0"), 3, 30, 100)


_TOPH = _SEARCH + f", hit AS (SELECT item_id, record_id, rank FROM r WHERE rank <= 20)"


@CORE("n28_candidate_communities", sql=_TOPH + ", c AS (SELECT item_id, community AS cid, count(*) AS holds, min(rank) AS first FROM hit JOIN sect_node USING (record_id) WHERE community >= 0 GROUP BY ALL) SELECT item_id, cid, holds, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY holds DESC, first, cid) AS rank FROM c) WHERE rank <= 3")
def n28(spark, d):
    """The three communities that hold most of the 20 sections retrieved for a test item."""
    h = _hits(spark, d, 20).join(sections(spark, d).filter("community >= 0").select("record_id", F.col("community").alias("cid")), "record_id")
    c = h.groupBy("item_id", "cid").agg(F.count(F.lit(1)).alias("holds"), F.min("rank").alias("first"))
    return top(c, ["item_id"], [F.col("holds").desc(), F.col("first"), F.col("cid")], 3).drop("first")


def _hits(spark, d, k):
    w = L.weights(L.postings(sections(spark, d), "record_id", "text"), "record_id")
    return cut(L.search(w, "record_id", table(spark, d, "eval_item"), "item_id", "text", k), "hits")


_CHUNK = POST.replace("record_id", "record_id").replace("sect_node", "lex_chunk_meta")


@CORE("n32_fold_search", sql=_CHUNK + f", {QUERY}, h AS (SELECT item_id, record_id, round(sum(w), 6) AS score FROM q JOIN wt USING (term) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, record_id) AS rank FROM h), f AS (SELECT item_id, build_id, doc_id, section_idx, max(score) AS score, count(*) AS chunks FROM r JOIN lex_chunk_meta USING (record_id) WHERE rank <= 144 AND NOT is_junk AND NOT is_reference GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, build_id, doc_id, section_idx) AS k FROM f) SELECT item_id, build_id, doc_id, section_idx, score, chunks, CAST(k AS INT) AS rank FROM k WHERE k <= 10")
def n32(spark, d):
    """The ten sections of the 144 best chunks of a test item: junk and reference chunks left out, chunks folded to their section."""
    c = table(spark, d, "lex_chunk_meta")
    w = L.weights(L.postings(c, "record_id", "text"), "record_id")
    h = L.search(w, "record_id", table(spark, d, "eval_item"), "item_id", "text", 144)
    f = h.join(c.filter("NOT is_junk AND NOT is_reference").select("record_id", "build_id", "doc_id", "section_idx"), "record_id").groupBy("item_id", "build_id", "doc_id", "section_idx").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("chunks"))
    return top(f, ["item_id"], [F.col("score").desc(), F.col("build_id"), F.col("doc_id"), F.col("section_idx")], 10)


_PACK = _TOPH.replace("WITH ", "WITH RECURSIVE ", 1) + """, u AS (SELECT item_id, record_id, rank, CAST(length(text) AS BIGINT) AS size FROM hit JOIN sect_node USING (record_id)), st AS (SELECT item_id, 0 AS rank, CAST(0 AS BIGINT) AS used, 0 AS kept, CAST(NULL AS BIGINT) AS record_id FROM (SELECT DISTINCT item_id FROM u)
UNION ALL SELECT st.item_id, CAST(u.rank AS INT), CASE WHEN kept = 0 OR used + size <= 6000 THEN used + size ELSE used END, CASE WHEN kept = 0 OR used + size <= 6000 THEN kept + 1 ELSE kept END, CASE WHEN kept = 0 OR used + size <= 6000 THEN u.record_id END FROM st JOIN u ON u.item_id = st.item_id AND u.rank = st.rank + 1)"""


@CORE("n35_whole_units", sql=_PACK + " SELECT item_id, record_id, rank, used FROM st WHERE record_id IS NOT NULL")
def n35(spark, d):
    """Whole sections of a test item's 20 best, in order, that fit 6,000 characters together."""
    u = _hits(spark, d, 20).join(sections(spark, d).select("record_id", "text"), "record_id")
    return S.pack_whole(u, "item_id", "record_id", F.length("text"), 6000)


@CORE("n34_evidence", sql=_TOPH + """, u AS (SELECT item_id, record_id, build_id, ord, community FROM hit JOIN sect_node USING (record_id) WHERE rank <= 10), m0 AS (SELECT DISTINCT b.build_id, ord, entity_id FROM mentions JOIN (SELECT build_id, json_extract_string(params, '$.run_id') AS run_id FROM sect_build) b USING (run_id) WHERE cnt > 0),
f0 AS (SELECT build_id, entity_id, count(*) AS df FROM m0 GROUP BY ALL HAVING count(*) <= 100), ue AS (SELECT item_id, record_id, community, build_id, entity_id FROM u JOIN m0 USING (build_id, ord) JOIN f0 USING (build_id, entity_id)),
x AS (SELECT p.item_id, p.record_id AS a, q.record_id AS b, count(*) AS shared, any_value(coalesce(p.community, -1) <> coalesce(q.community, -1)) AS crossing FROM ue p JOIN ue q ON p.item_id = q.item_id AND p.build_id = q.build_id AND p.entity_id = q.entity_id AND p.record_id < q.record_id GROUP BY ALL) SELECT item_id, a, b, shared, crossing FROM x""")
def n34(spark, d):
    """Links among the ten sections retrieved for a test item: rare entities two of them share, and whether they cross communities."""
    u = _hits(spark, d, 10).select("item_id", "record_id").join(sections(spark, d).select("record_id", "build_id", "ord", F.coalesce("community", F.lit(-1)).alias("c")), "record_id")
    m = mentions(spark, d)
    rare = m.groupBy("build_id", "entity_id").agg(F.count(F.lit(1)).alias("df")).filter("df <= 100").select("build_id", "entity_id")
    e = cut(u.join(m.select("build_id", "ord", "entity_id"), ["build_id", "ord"]).join(rare, ["build_id", "entity_id"], "left_semi"), "evidence")
    y = e.select("item_id", "build_id", "entity_id", F.col("record_id").alias("b"), F.col("c").alias("cb"))
    j = e.select("item_id", "build_id", "entity_id", F.col("record_id").alias("a"), F.col("c").alias("ca")).join(y, ["item_id", "build_id", "entity_id"]).filter("a < b")  # ten sections an item
    return j.groupBy("item_id", "a", "b").agg(F.count(F.lit(1)).alias("shared"), F.first(F.col("ca") != F.col("cb")).alias("crossing"))
