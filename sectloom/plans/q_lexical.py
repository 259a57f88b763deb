"""Lexical index and scoring: L01-L25, and A18 on their rankings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sectloom.functions import stats
from sectloom.functions.text import tokenize
from sectloom.operators import lexical as L
from sectloom.plans.base import mentions, post, sections
from sectloom.plans.registry import CORE
from sectloom.plans.runtime import cut, forget, table
from sectloom.plans.sqlparts import MENTIONS, POST, QUERY, tokens

K = 10
#: Most rows of a numbered list that is broadcast.
MAX_NUMBERED = 500_000


def _w(spark, d):
    return cut(L.weights(post(spark, d), "record_id"), "weights")


def _queries(spark, d):
    return table(spark, d, "eval_item")


@CORE("l01_inverted_index", sql=POST + "SELECT term, df, cf FROM df")
def l01(spark, d):
    """Document and collection frequency of every term."""
    return L.doc_freq(post(spark, d))


@CORE("l01_doc_lengths", sql=POST + "SELECT record_id, dl FROM dl")
def l01b(spark, d):
    """Length of every section in index tokens."""
    return L.doc_lengths(post(spark, d), "record_id")


@CORE("l02_bm25_matrix", sql=POST + "SELECT record_id, term, round(w, 6) AS w FROM wt")
def l02(spark, d):
    """BM25 weight of every posting."""
    return L.weights(post(spark, d), "record_id").select("record_id", "term", F.round("w", 6).alias("w"))


@CORE("l03_section_weight", sql=POST + "SELECT record_id, round(sum(w), 4) AS mass, count(*) AS n_terms FROM wt GROUP BY record_id")
def l03(spark, d):
    """Total BM25 weight of each section."""
    return L.weights(post(spark, d), "record_id").groupBy("record_id").agg(F.round(F.sum("w"), 4).alias("mass"), F.count(F.lit(1)).alias("n_terms"))


_SEARCH = POST + f", {QUERY}, h AS (SELECT item_id, record_id, round(sum(w), 6) AS score, count(*) AS terms_hit FROM q JOIN wt USING (term) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, record_id) AS rank FROM h) "


@CORE("l04_bm25_search", sql=_SEARCH + "SELECT item_id, record_id, score, terms_hit, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10")
def l04(spark, d):
    """The ten best sections of every test item."""
    return L.search(_w(spark, d), "record_id", _queries(spark, d), "item_id", "text", K)


_ALIAS = """, al AS (SELECT DISTINCT build_id, least(a, b) AS x, greatest(a, b) AS y FROM sect_entity_edge WHERE kind = 'alias' AND a IS NOT NULL AND b IS NOT NULL AND a <> b), bo AS (SELECT build_id, x AS entity_id, y AS alias_id FROM al UNION ALL SELECT build_id, y, x FROM al)"""


@CORE("l05_alias_expansion", sql=MENTIONS + _ALIAS + ", ex AS (SELECT build_id, entity_id, entity_id AS term_id FROM bo UNION SELECT build_id, entity_id, alias_id FROM bo) SELECT ex.build_id, ex.entity_id, count(DISTINCT CASE WHEN term_id = ex.entity_id THEN m.ord END) AS own, count(DISTINCT m.ord) AS expanded FROM ex LEFT JOIN m ON m.build_id = ex.build_id AND m.entity_id = term_id GROUP BY ALL")
def l05(spark, d):
    """Searches for an entity with and without its aliases as further OR terms: sections found by it alone, and by any of them."""
    a = table(spark, d, "sect_entity_edge").filter("kind = 'alias' AND a IS NOT NULL AND b IS NOT NULL AND a <> b").select("build_id", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()
    both = a.select("build_id", F.explode(F.array(F.struct(F.col("x").alias("entity_id"), F.col("y").alias("term_id")), F.struct(F.col("y").alias("entity_id"), F.col("x").alias("term_id")))).alias("z")).select("build_id", "z.*")
    ex = both.unionByName(both.select("build_id", "entity_id", F.col("entity_id").alias("term_id"))).distinct()
    m = mentions(spark, d).select("build_id", F.col("entity_id").alias("term_id"), "ord")
    return ex.join(m, ["build_id", "term_id"], "left").groupBy("build_id", "entity_id").agg(F.countDistinct(F.when(F.col("term_id") == F.col("entity_id"), F.col("ord"))).alias("own"), F.countDistinct("ord").alias("expanded"))


@CORE("l06_term_stats", sql=POST + f", {QUERY}, t AS (SELECT DISTINCT term FROM q) SELECT t.term, coalesce(df, 0) AS df, coalesce(cf, 0) AS cf FROM t LEFT JOIN df USING (term)")
def l06(spark, d):
    """Frequencies of all query terms, those in no section too."""
    t = _queries(spark, d).select(F.explode(tokenize(F.col("text"))).alias("term")).distinct()
    return t.join(L.doc_freq(post(spark, d)), "term", "left").fillna(0, ["df", "cf"])


@CORE("l07_source_topk", sql=POST + f", {QUERY}, h AS (SELECT item_id, build_id, record_id, round(sum(w), 6) AS score FROM q JOIN wt USING (term) JOIN sect_node USING (record_id) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY item_id, build_id ORDER BY score DESC, record_id) AS rank FROM h) SELECT item_id, build_id, record_id, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3")
def l07(spark, d):
    """The three best sections of each build for every test item."""
    terms = _queries(spark, d).select("item_id", F.explode(F.array_distinct(tokenize(F.col("text")))).alias("term"))
    w = _w(spark, d).join(sections(spark, d).select("record_id", "build_id"), "record_id")
    h = terms.join(w.select("record_id", "build_id", "term", "w"), "term").groupBy("item_id", "build_id", "record_id").agg(F.round(F.sum("w"), 6).alias("score"))
    return L.top(h, ["item_id", "build_id"], [F.col("score").desc(), F.col("record_id")], 3)


_CTERM = POST + """, ct AS (SELECT community AS cid, term, CAST(sum(tf) AS BIGINT) AS tf FROM post JOIN sect_node USING (record_id) WHERE community IS NOT NULL AND community >= 0 GROUP BY ALL),
cl AS (SELECT cid, CAST(sum(tf) AS BIGINT) AS dl FROM ct GROUP BY cid), cn AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM cl), cd AS (SELECT term, count(*) AS df FROM ct GROUP BY term),
cw AS (SELECT cid, term, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM ct JOIN cl USING (cid) JOIN cd USING (term), cn) """


def _community_tf(spark, d):
    s = sections(spark, d).filter("community IS NOT NULL AND community >= 0").select("record_id", F.col("community").alias("cid"))
    return post(spark, d).join(s, "record_id").groupBy("cid", "term").agg(F.sum("tf").alias("tf"))


@CORE("l08_community_terms", sql=_CTERM + ", r AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY score DESC, term) AS rank FROM cw) SELECT cid, term, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10")
def l08(spark, d):
    """The ten best BM25 terms of each community taken as one document."""
    w = L.weights(cut(_community_tf(spark, d), "ct"), "cid").select("cid", "term", F.round("w", 6).alias("score"))
    return L.top(w, ["cid"], [F.col("score").desc(), F.col("term")], 10)


@CORE("l09_query_community_terms", sql=_CTERM + f", {QUERY}, r AS (SELECT item_id, cid, term, score, row_number() OVER (PARTITION BY item_id, cid ORDER BY score DESC, term) AS rank FROM cw JOIN q USING (term)) SELECT item_id, cid, term, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3")
def l09(spark, d):
    """The best terms of each community that a test item names."""
    w = L.weights(cut(_community_tf(spark, d), "ct"), "cid").select("cid", "term", F.round("w", 6).alias("score"))
    q = _queries(spark, d).select("item_id", F.explode(F.array_distinct(tokenize(F.col("text")))).alias("term"))
    return L.top(q.join(w, "term").select("item_id", "cid", "term", "score"), ["item_id", "cid"], [F.col("score").desc(), F.col("term")], 3)


@CORE("l10_salient_terms", sql=POST + """, x AS (SELECT record_id, term, ln(1 + w) AS v FROM wt), m AS (SELECT record_id, median(v) AS med, avg(v) AS mean, stddev_pop(v) AS sd FROM x GROUP BY record_id),
a AS (SELECT record_id, median(abs(v - med)) AS mad FROM x JOIN m USING (record_id) GROUP BY record_id)
SELECT record_id, term FROM x JOIN m USING (record_id) JOIN a USING (record_id) WHERE round(v, 6) >= round(least(med - 1.4826 * mad, mean - sd), 6)""")
def l10(spark, d):
    """Terms of a section above the robust gate on log weights."""
    x = L.weights(post(spark, d), "record_id").select("record_id", "term", F.log1p("w").alias("v"))
    m = x.groupBy("record_id").agg(F.median("v").alias("med"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))
    j = x.join(m, "record_id")
    a = j.groupBy("record_id").agg(F.median(F.abs(F.col("v") - F.col("med"))).alias("mad"))
    gate = F.least(F.col("med") - 1.4826 * F.col("mad"), F.col("mean") - F.col("sd"))
    return j.join(a, "record_id").filter(F.round("v", 6) >= F.round(gate, 6)).select("record_id", "term")


_UNIT = POST + """, v AS (SELECT record_id, term, w FROM wt WHERE df <= n / 2), nr AS (SELECT record_id, sqrt(sum(w * w)) AS l FROM v GROUP BY record_id), u AS (SELECT record_id, term, w / l AS u FROM v JOIN nr USING (record_id)) """


def _unit(spark, d):
    """Unit rows without terms in more than half of all sections."""
    return cut(L.unit_rows(_w(spark, d).filter(F.col("df") <= F.col("n") / 2), "record_id").select("record_id", "term", "u"), "unit")


@CORE("l11_unit_rows", sql=_UNIT + "SELECT record_id, term, round(u, 6) AS u FROM u")
def l11(spark, d):
    """Weights without the most frequent terms, rows of unit length."""
    return _unit(spark, d).select("record_id", "term", F.round("u", 6).alias("u"))


@CORE("l12_frozen_row", sql=POST + f""", q AS (SELECT item_id, unnest({tokens('text')}) AS term FROM eval_item), t AS (SELECT item_id, term, count(*) AS qtf FROM q GROUP BY ALL), l AS (SELECT item_id, sum(qtf) AS ql FROM t GROUP BY ALL)
SELECT item_id, term, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * (qtf * 2.5 / (qtf + 1.5 * (0.25 + 0.75 * ql / avgdl))), 6) AS w FROM t JOIN l USING (item_id) JOIN df USING (term), nn""")
def l12(spark, d):
    """Rows of new documents under the statistics of the index; unknown terms drop out."""
    p = post(spark, d)
    t = L.postings(_queries(spark, d), "item_id", "text")
    l = t.groupBy("item_id").agg(F.sum("tf").alias("ql"))
    one = L.corpus_size(p, "record_id")
    j = t.join(l, "item_id").join(L.doc_freq(p), "term").crossJoin(F.broadcast(one))  # one row
    return j.select("item_id", "term", F.round(stats.bm25(F.col("tf"), F.col("df"), F.col("ql"), F.col("n"), F.col("avgdl")), 6).alias("w"))


@CORE("l13_sampled_df", sql=POST + """, s AS (SELECT record_id FROM dl WHERE CAST(('0x' || md5('s7:' || record_id)[1:12]) AS BIGINT) < 140737488355328), k AS (SELECT (SELECT count(*) FROM dl) AS total, (SELECT count(*) FROM s) AS n),
d AS (SELECT term, count(*) AS c FROM post JOIN s USING (record_id) GROUP BY term) SELECT term, CAST(greatest(1, least(total, round_even(c * total / n, 0))) AS BIGINT) AS df FROM d, k""")
def l13(spark, d):
    """Document frequencies estimated from the half of the sections whose hash is in the lower half (a sampling operator)."""
    p = post(spark, d)
    low = F.conv(F.substring(F.md5(F.concat(F.lit("s7:"), F.col("record_id").cast("string"))), 1, 12), 16, 10).cast("long") < 1 << 47
    ids = L.doc_lengths(p, "record_id").select("record_id", low.alias("low"))
    one = ids.agg(F.count(F.lit(1)).alias("total"), F.sum(F.col("low").cast("long")).alias("n"))
    c = p.filter(low).groupBy("term").agg(F.count(F.lit(1)).alias("c")).crossJoin(F.broadcast(one))  # one row
    est = F.bround(F.col("c") * F.col("total") / F.col("n"), 0)
    return c.select("term", F.greatest(F.lit(1.0), F.least(F.col("total").cast("double"), est)).cast("long").alias("df"))


@CORE("l14_hashed_sample", sql="SELECT record_id FROM (SELECT record_id, row_number() OVER (ORDER BY md5(CAST(record_id AS VARCHAR) || 'sample'), record_id) AS r FROM sect_node) WHERE r <= 100")
def l14(spark, d):
    """A sample of 100 sections by hash order (a sampling operator)."""
    return sections(spark, d).select("record_id").orderBy(F.md5(F.concat(F.col("record_id").cast("string"), F.lit("sample"))), "record_id").limit(100)


@CORE("l15_query_features", sql=POST + f", q AS (SELECT item_id, unnest({tokens('text')}) AS term FROM eval_item), t AS (SELECT item_id, term, count(*) AS qtf FROM q GROUP BY ALL) SELECT item_id, term, round(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS w FROM t JOIN df USING (term), nn")
def l15(spark, d):
    """Query weights: frequency times idf."""
    p = post(spark, d)
    t = L.postings(_queries(spark, d), "item_id", "text")
    j = t.join(L.doc_freq(p), "term").crossJoin(F.broadcast(L.corpus_size(p, "record_id")))  # one row
    return j.select("item_id", "term", F.round(F.col("tf") * stats.idf(F.col("n"), F.col("df")), 6).alias("w"))


_IP = POST + f""", q AS (SELECT item_id, unnest({tokens('text')}) AS term FROM eval_item), t AS (SELECT item_id, term, count(*) AS qtf FROM q GROUP BY ALL), ad AS (SELECT avgdl FROM nn),
h AS (SELECT item_id, record_id, round(sum(qtf * w), 6) AS score FROM t JOIN wt USING (term) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, record_id) AS rank FROM h) """


def _ip(spark, d, k=K):
    t = L.postings(_queries(spark, d), "item_id", "text").select("item_id", "term", F.col("tf").alias("qtf"))
    h = t.join(_w(spark, d), "term").groupBy("item_id", "record_id").agg(F.round(F.sum(F.col("qtf") * F.col("w")), 6).alias("score"))
    return L.top(h, ["item_id"], [F.col("score").desc(), F.col("record_id")], k)


@CORE("l16_sparse_topk", sql=_IP + "SELECT item_id, record_id, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10")
def l16(spark, d):
    """Exact sparse inner-product search."""
    return _ip(spark, d)


@CORE("l17_sparse_topk_deep", sql=_IP + "SELECT item_id, record_id, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 50")
def l17(spark, d):
    """The same to rank 50, the pool that later stages rerank."""
    return _ip(spark, d, 50)


@CORE("l18_joint_view", sql=f"""WITH t AS (SELECT record_id, {tokens('text')} AS t FROM sect_node WHERE text IS NOT NULL), p AS (SELECT record_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS pair FROM t),
c AS (SELECT record_id, pair, count(*) AS tf FROM p GROUP BY ALL), f AS (SELECT pair, count(*) AS df FROM c GROUP BY pair), n AS (SELECT count(DISTINCT record_id) AS n FROM t),
w AS (SELECT record_id, pair, tf * ln(1 + (n - df + 0.5) / (df + 0.5)) AS w FROM c JOIN f USING (pair), n WHERE df >= 2 AND df <= n / 2), l AS (SELECT record_id, sqrt(sum(w * w)) AS l FROM w GROUP BY record_id)
SELECT record_id, pair, round(w / l, 6) AS u FROM w JOIN l USING (record_id)""")
def l18(spark, d):
    """Pair half of the joint view: adjacent token pairs in at least 2 and at most half of the sections, rows of unit length."""
    t = sections(spark, d).filter("text IS NOT NULL").select("record_id", tokenize(F.col("text")).alias("t"))
    p = t.select("record_id", F.explode(F.expr("transform(sequence(1, greatest(size(t) - 1, 1)), i -> case when i < size(t) then concat(t[i - 1], ' ', t[i]) end)")).alias("pair")).filter("pair IS NOT NULL")
    c = p.groupBy("record_id", "pair").agg(F.count(F.lit(1)).alias("tf"))
    f = c.groupBy("pair").agg(F.count(F.lit(1)).alias("df"))
    n = t.agg(F.countDistinct("record_id").alias("n"))
    w = c.join(f, "pair").crossJoin(F.broadcast(n)).filter("df >= 2 AND df <= n / 2").withColumn("w", F.col("tf") * stats.idf(F.col("n"), F.col("df")))  # one row
    return L.unit_rows(w, "record_id").select("record_id", "pair", F.round("u", 6).alias("u"))


@CORE("l19_query_pairs", sql=f"""WITH t AS (SELECT item_id, {tokens('text')} AS t FROM eval_item), v AS (SELECT DISTINCT unnest({tokens('text')}) AS term FROM sect_node WHERE text IS NOT NULL),
p AS (SELECT item_id, unnest(list_transform(range(1, len(t)), lambda i: struct_pack(a := t[i], b := t[i + 1]))) AS p FROM t) SELECT item_id, p.a AS a, p.b AS b, count(*) AS n FROM p WHERE p.a IN (SELECT term FROM v) AND p.b IN (SELECT term FROM v) GROUP BY ALL""")
def l19(spark, d):
    """Adjacent query tokens that the index knows; an unknown token breaks the chain."""
    v = sections(spark, d).filter("text IS NOT NULL").select(F.explode(tokenize(F.col("text"))).alias("term")).distinct()
    t = _queries(spark, d).select("item_id", F.posexplode(tokenize(F.col("text"))).alias("i", "a"))
    w = Window.partitionBy("item_id").orderBy("i")
    p = t.withColumn("b", F.lead("a").over(w)).filter("b IS NOT NULL")
    p = p.join(v.select(F.col("term").alias("a")), "a", "left_semi").join(v.select(F.col("term").alias("b")), "b", "left_semi")
    return p.groupBy("item_id", "a", "b").agg(F.count(F.lit(1)).alias("n"))


@CORE("l20_adjacency_rerank", sql=POST + f""", t AS (SELECT record_id, {tokens('text')} AS t FROM sect_node WHERE text IS NOT NULL), p AS (SELECT record_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS pair FROM t), c AS (SELECT record_id, pair, count(*) AS c FROM p GROUP BY ALL),
qt AS (SELECT item_id, {tokens('text')} AS t FROM eval_item), qp AS (SELECT item_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS pair FROM qt), qc AS (SELECT item_id, pair, count(*) AS q FROM qp GROUP BY ALL), qn AS (SELECT item_id, sum(q) AS n FROM qc GROUP BY item_id),
s AS (SELECT item_id, record_id, round(sum(least(c, q)) / any_value(qn.n), 6) AS score FROM qc JOIN c USING (pair) JOIN qn USING (item_id) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, record_id) AS rank FROM s) SELECT item_id, record_id, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10""")
def l20(spark, d):
    """Sections by the share of a query's directed word pairs they hold."""
    pair = F.expr("transform(sequence(1, greatest(size(t) - 1, 1)), i -> case when i < size(t) then concat(t[i - 1], ' ', t[i]) end)")
    c = sections(spark, d).filter("text IS NOT NULL").select("record_id", tokenize(F.col("text")).alias("t")).select("record_id", F.explode(pair).alias("pair")).filter("pair IS NOT NULL").groupBy("record_id", "pair").agg(F.count(F.lit(1)).alias("c"))
    q = _queries(spark, d).select("item_id", tokenize(F.col("text")).alias("t")).select("item_id", F.explode(pair).alias("pair")).filter("pair IS NOT NULL").groupBy("item_id", "pair").agg(F.count(F.lit(1)).alias("q"))
    n = q.groupBy("item_id").agg(F.sum("q").alias("n"))
    s = q.join(c, "pair").groupBy("item_id", "record_id").agg(F.sum(F.least("c", "q")).alias("m")).join(n, "item_id").select("item_id", "record_id", F.round(F.col("m") / F.col("n"), 6).alias("score"))
    return L.top(s, ["item_id"], [F.col("score").desc(), F.col("record_id")], K)


@CORE("l21_or_search", sql=POST + f", {QUERY}, h AS (SELECT item_id, record_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5))), 6) AS score FROM q JOIN wt USING (term) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, record_id) AS rank FROM h) SELECT item_id, record_id, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10")
def l21(spark, d):
    """OR search by summed idf of the words found."""
    q = _queries(spark, d).select("item_id", F.explode(F.array_distinct(tokenize(F.col("text")))).alias("term"))
    h = q.join(_w(spark, d), "term").groupBy("item_id", "record_id").agg(F.round(F.sum(stats.idf(F.col("n"), F.col("df"))), 6).alias("score"))
    return L.top(h, ["item_id"], [F.col("score").desc(), F.col("record_id")], K)


_TRI = "list_distinct(list_transform(range(1, length(x) - 1), lambda i: x[i:i + 2]))"


@CORE("l22_trigram_match", sql=f"""WITH t AS (SELECT DISTINCT lower(section_title) AS title, '  ' || lower(section_title) || ' ' AS x FROM sect_node WHERE section_title IS NOT NULL), g AS (SELECT title, {_TRI} AS g FROM t), e AS (SELECT title, len(g) AS n, unnest(g) AS g FROM g),
m AS (SELECT q.title AS q, e.title, count(*) AS c, any_value(q.n) AS qn, any_value(e.n) AS n FROM e q JOIN e USING (g) WHERE q.title <> e.title GROUP BY ALL) SELECT q AS query, title, round(c / (qn + n - c), 6) AS score FROM m WHERE c / (qn + n - c) >= 0.5""")
def l22(spark, d):
    """Titles whose character trigrams overlap those of another title by half or more."""
    t = sections(spark, d).filter("section_title IS NOT NULL").select(F.lower("section_title").alias("title")).distinct()
    x = t.withColumn("x", F.concat(F.lit("  "), "title", F.lit(" ")))
    g = cut(x.select("title", F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("x") - 2), lambda i: F.xxhash64(F.substring(F.col("x"), i, F.lit(3))))).alias("g")), "grams")
    m = L.overlapping_sets(g, "title", "g", 0.5)
    two = F.explode(F.array(F.struct(F.col("a").alias("query"), F.col("b").alias("title")), F.struct(F.col("b").alias("query"), F.col("a").alias("title"))))
    return m.select(two.alias("z"), F.round("s", 6).alias("score")).select("z.query", "z.title", "score")


@CORE("l23_term_share", sql=_UNIT + ", t AS (SELECT term, sum(u * u) AS own, count(*) AS df FROM u GROUP BY term) SELECT term, round(own / df, 6) AS self_share FROM t")
def l23(spark, d):
    """Mean share of a term in the self-similarity of the sections that hold it."""
    return _unit(spark, d).groupBy("term").agg(F.round(F.sum(F.col("u") * F.col("u")) / F.count(F.lit(1)), 6).alias("self_share"))


_EDGE_SHARE = _UNIT + """, b AS (SELECT build_id, ord, record_id FROM sect_node), e AS (SELECT DISTINCT x.record_id AS a, y.record_id AS b FROM b x JOIN b y ON x.build_id = y.build_id AND y.ord = x.ord + 1),
c AS (SELECT e.a, e.b, ua.term, ua.u * ub.u AS c FROM e JOIN u ua ON ua.record_id = e.a JOIN u ub ON ub.record_id = e.b AND ub.term = ua.term) SELECT a, b, count(*) AS n_terms, round(sum(c), 6) AS sim, round(max(c) / sum(c), 6) AS top_share FROM c GROUP BY a, b"""


@CORE("l24_edge_share", sql=_EDGE_SHARE)
def l24(spark, d):
    """Share of its heaviest term in the similarity of neighbouring sections."""
    u = _unit(spark, d)
    b = sections(spark, d).select("build_id", "ord", "record_id")
    e = b.select("build_id", (F.col("ord") + 1).alias("ord"), F.col("record_id").alias("a")).join(b.withColumnRenamed("record_id", "b"), ["build_id", "ord"]).select("a", "b").distinct()
    c = e.join(u.select(F.col("record_id").alias("a"), "term", F.col("u").alias("ua")), "a").join(u.select(F.col("record_id").alias("b"), "term", F.col("u").alias("ub")), ["b", "term"]).withColumn("c", F.col("ua") * F.col("ub"))
    return c.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_terms"), F.round(F.sum("c"), 6).alias("sim"), F.round(F.max("c") / F.sum("c"), 6).alias("top_share"))


_TITLE = POST + f""", g AS (SELECT min(record_id) AS gold, section_title FROM sect_node WHERE length(section_title) > 20 GROUP BY section_title HAVING count(*) = 1), q AS (SELECT DISTINCT gold, unnest({tokens('section_title')}) AS term FROM g),
h AS (SELECT gold, record_id, round(sum(w), 6) AS score FROM q JOIN wt USING (term) GROUP BY ALL), t AS (SELECT gold, max(CASE WHEN record_id = gold THEN score END) AS truth FROM h GROUP BY gold), k AS (SELECT gold, any_value(truth) AS truth, CAST(sum(CASE WHEN score > truth THEN 1 ELSE 0 END) AS BIGINT) AS better FROM h JOIN t USING (gold) GROUP BY gold) """


def _title_ranks(spark, d):
    g = sections(spark, d).filter("length(section_title) > 20").groupBy("section_title").agg(F.min("record_id").alias("gold"), F.count(F.lit(1)).alias("c")).filter("c = 1")
    q = g.select("gold", F.explode(tokenize(F.col("section_title"))).alias("term"))
    rows = cut(L.document_tokens(sections(spark, d), "record_id", "text"), "tokens")
    forget(rows)
    return L.truth_ranks(rows, "record_id", q, "gold")


@CORE("l25_rank_of_truth", sql=_TITLE + "SELECT gold, better FROM k WHERE truth IS NOT NULL")
def l25(spark, d):
    """Sections that score strictly better than the one a unique title belongs to."""
    return _title_ranks(spark, d).filter("truth IS NOT NULL").select("gold", "better")


@CORE("a18_retrieval_metrics", sql=_TITLE + "SELECT count(*) AS n, round(avg(CASE WHEN truth IS NOT NULL AND better < 10 THEN 1.0 ELSE 0.0 END), 6) AS hit10, round(avg(CASE WHEN truth IS NOT NULL THEN 1.0 / (1 + better) ELSE 0.0 END), 6) AS mrr FROM k")
def a18(spark, d):
    """Hit rate at ten and mean reciprocal rank of title queries."""
    k = _title_ranks(spark, d)
    found = F.col("truth").isNotNull()
    return k.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(found & (F.col("better") < 10), 1.0).otherwise(0.0)), 6).alias("hit10"), F.round(F.avg(F.when(found, 1.0 / (1 + F.col("better"))).otherwise(0.0)), 6).alias("mrr"))


@CORE("a18_bootstrap", sql=_TITLE + """, x AS (SELECT gold, CASE WHEN truth IS NOT NULL THEN 1.0 / (1 + better) ELSE 0.0 END AS rr, row_number() OVER (ORDER BY gold) - 1 AS i, count(*) OVER () AS n FROM k), r AS (SELECT unnest(range(200)) AS rep),
p AS (SELECT rep, i, n, CAST(('0x' || md5(CAST(rep AS VARCHAR) || ':' || CAST(i AS VARCHAR))[1:12]) AS BIGINT) % n AS j FROM x, r), s AS (SELECT rep, round(avg(x.rr), 6) AS m FROM p JOIN x ON x.i = p.j GROUP BY rep) SELECT rep, m FROM s""")
def a18b(spark, d):
    """Bootstrap replicates of the mean reciprocal rank, drawn by hash."""
    k = cut(_title_ranks(spark, d).select("gold", F.when(F.col("truth").isNotNull(), 1.0 / (1 + F.col("better"))).otherwise(0.0).alias("rr")), "rr")
    x = cut(k.withColumn("i", F.row_number().over(Window.orderBy("gold")) - 1), "numbered")  # two numbers a title that occurs once
    n = x.count()
    p = x.select("i").repartition(1 + n // 4096).select("i", F.explode(F.sequence(F.lit(0), F.lit(199))).alias("rep")).select("rep", F.expr(f"cast(conv(substring(md5(concat(rep, ':', i)), 1, 12), 16, 10) as bigint) % {max(1, n)}").alias("j"))
    y = x.select(F.col("i").alias("j"), "rr")
    y = F.broadcast(y) if n <= MAX_NUMBERED else y
    return p.join(y, "j").groupBy(F.col("rep").cast("long").alias("rep")).agg(F.round(F.avg("rr"), 6).alias("m"))
