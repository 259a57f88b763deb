"""Operators against hand-counted and brute-force results, and on dirty input."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sectloom.functions import stats
from sectloom.functions import text as X
from sectloom.operators import aggregate as A
from sectloom.operators import boxcox, communities, dense, entities, graph, lexical, lifecycle, segment, selection, simgraph
from sectloom.sources import corpora
from sectloom.streaming import ingest


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_tokenizer(spark):
    t = lambda s: one(spark, X.tokenize(F.lit(s)))
    assert t("In 1994 the Graph's 1990s ab ABC-123 résumé") == ["1990s", "graph", "1990s", "abc", "123", "sum"]
    assert t("") == [] and one(spark, X.tokenize(F.lit(None).cast("string"))) is None


def test_text_rules(spark):
    r = lambda s: one(spark, X.is_reference(F.lit(s)))
    assert r("7. References") and r("Bibliography") and not r("Citation Intent Classification")
    assert one(spark, X.heading_kind(F.lit("3.2 Related Work!"))) == "related work"
    assert one(spark, X.stem_key(F.lit("2401_12345v3_methods"))) == "2401_12345_methods" and one(spark, X.stem_version(F.lit("2401_12345v3"))) == 3
    assert one(spark, X.stem_version(F.lit("a book"))) == 1 and one(spark, X.stem_key(F.lit("a book"))) == "a book"
    assert one(spark, X.toon(F.lit("a: b"))) == '"a: b"' and one(spark, X.toon(F.lit("plain"))) == "plain" and one(spark, X.toon(F.lit("12"))) == '"12"'
    assert one(spark, X.wiki_title(F.lit(" = Title = \n text"))) == "Title" and one(spark, X.wiki_title(F.lit("no"))) is None
    assert one(spark, X.is_junk(F.lit("--\n--"))) and not one(spark, X.is_junk(F.lit("words here")))
    assert one(spark, X.gram_tokens(F.lit("XR-2201B o'brien 3.5mm"))) == ["xr2201b", "o'brien", "35mm"]


def test_statistics(spark):
    v = one(spark, stats.g2(F.lit(10.0), F.lit(20.0), F.lit(30.0), F.lit(100.0)))
    k = [(10, 20 * 30 / 100), (10, 20 * 70 / 100), (20, 80 * 30 / 100), (60, 80 * 70 / 100)]
    assert abs(v - 2 * sum(a * math.log(a / e) for a, e in k)) < 1e-9
    assert one(spark, stats.npmi(F.lit(5.0), F.lit(5.0), F.lit(5.0), F.lit(5.0))) == 0
    assert abs(stats.t_sf(2.0, 10) - 0.036694) < 1e-5 and abs(stats.t_sf(-2.0, 10) - 0.963306) < 1e-5
    assert abs(stats.inverse_normal(0.975) - 1.959964) < 1e-6


def test_search_and_ties(spark):
    d = spark.createDataFrame([(1, "apple pear pear"), (2, "apple kiwi"), (3, "apple kiwi"), (4, None), (5, "")], "id int, text string")
    w = lexical.weights(lexical.postings(d, "id", "text"), "id")
    q = spark.createDataFrame([(7, "kiwi kiwi apple"), (8, "unknown")], "q int, text string")
    r = lexical.search(w, "id", q, "q", "text", 2).orderBy("rank").collect()
    assert [(x.q, x.id, x.terms_hit) for x in r] == [(7, 2, 2), (7, 3, 2)] and r[0].score == r[1].score


def test_boxcox_power(spark):
    rnd = random.Random(1)
    x = spark.createDataFrame([("log", math.exp(rnd.gauss(0, 1))) for _ in range(400)] + [("lin", 50 + rnd.gauss(0, 1) ) for _ in range(400)], "g string, x double")
    p = {r.g: r.lam for r in boxcox.powers(x, "g").collect()}
    assert abs(p["log"]) <= 0.15
    v = [r.x for r in x.filter("g = 'log'").collect()]

    def llf(l):
        t = np.log(v) if abs(l) < 1e-9 else (np.power(v, l) - 1) / l
        return (l - 1) * np.log(v).sum() - len(v) / 2 * math.log(t.var())

    assert llf(p["log"]) >= max(llf(l / 200) for l in range(-200, 201)) - 1e-4


def test_windows_conserve(spark):
    d = spark.createDataFrame([(i, "\n\n".join(f"p{j}" for j in range(i))) for i in range(1, 30)] + [(99, None)], "id int, text string")
    w = segment.windows(d, "id", "text", 8).groupBy("id").agg(F.sum("n").alias("n")).collect()
    assert {r.id: r.n for r in w} == {i: i for i in range(1, 30)}


def test_recursive_split():
    rnd = random.Random(2)
    for _ in range(100):
        x = "".join(rnd.choice(["word ", "a. ", "\n\n", "\n", "longlonglong"]) for _ in range(rnd.randrange(1, 80)))
        s = segment.recursive_split(x, 50)
        assert s[0][0] == 0 and s[-1][1] == len(x) and all(b - a <= 50 for a, b in s) and all(p[1] == q[0] for p, q in zip(s, s[1:]))


def test_sentences_guard_abbreviations():
    x = "See Fig. 3 of Dr. Smith. It works. A. Tall man."
    assert [x[a:b] for a, b in segment.split_sentences(x)] == ["See Fig. 3 of Dr. Smith.", "It works.", "A. Tall man."]


def test_block_search_equals_brute_force(spark):
    g = np.random.default_rng(0)
    x = g.normal(size=(70, 8))
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = {(r.query, r["rank"]): r.id for r in dense.block_topk(d, d.filter("id % 10 = 0"), "id", "v", 5, block=16).collect()}
    s = np.round(x @ x.T, 6)
    np.fill_diagonal(s, -9)
    assert got == {(q, k + 1): i for q in range(0, 70, 10) for k, i in enumerate(sorted(range(70), key=lambda j: (-s[q, j], j))[:5])}


def _graph(spark):
    e = [(1, 0, 1, 0.9), (1, 1, 2, 0.8), (1, 2, 3, 0.7), (1, 1, 5, 0.6), (1, 8, 9, 0.5)]
    d = spark.createDataFrame(e, "build_id long, a int, b int, s double")
    return d, d.unionByName(d.select("build_id", F.col("b").alias("a"), F.col("a").alias("b"), "s"))


def test_walk(spark):
    e, y = _graph(spark)
    s = spark.createDataFrame([(1, 0)], "build_id long, seed int")
    r = {x.node: (round(x.score, 6), x.hop) for x in graph.best_reach(graph.expand_paths(y, s, 2, 0.05)).collect()}
    assert r == {1: (0.9, 1), 2: (0.72, 2), 5: (0.54, 2)}
    c = {x.node: round(x.cost, 6) for x in graph.cheapest_paths(y, s, 0.0).collect()}
    assert c[3] == round(-math.log(0.9 * 0.8 * 0.7), 6) and c[0] == 0 and 8 not in c
    b = {x.node: x.hop for x in graph.beam_walk(y, s, 3, 3).collect()}
    assert b == {0: 0, 1: 1, 2: 2}


def test_components_and_ranks(spark):
    e, y = _graph(spark)
    n = spark.createDataFrame([(i,) for i in range(10)], "id int")
    c = {r.id: r.component for r in graph.components(e, n).collect()}
    assert c == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 0, 6: 6, 7: 7, 8: 8, 9: 8}
    p = {r.id: r["rank"] for r in graph.pagerank(y, 0.85, 60).collect()}
    assert abs(sum(p.values()) - 1) < 1e-6 and p[1] > p[0]
    b = {r.id: r.score for r in graph.betweenness(y, y.select("build_id", F.col("a").alias("src")).distinct()).collect()}
    assert b[1] == 10 and b[2] == 6 and b[0] == 0


def test_triangles(spark):
    e = spark.createDataFrame([(1, a, b, 1.0) for a, b in itertools.combinations(range(4), 2)] + [(1, 3, 9, 1.0)], "build_id long, a int, b int, s double")
    assert {r.id: r.triangles for r in graph.triangles(e).collect()} == {i: 3 for i in range(4)}


def test_louvain_splits_two_cliques(spark):
    pairs = [(a, b, 1.0) for g in (0, 10) for a, b in itertools.combinations(range(g, g + 5), 2)] + [(4, 10, 0.1)]
    e = spark.createDataFrame([(1, *p) for p in pairs], "build_id long, a int, b int, s double")
    m = graph.louvain(e, ["build_id"])
    assert {r.id: r.cid for r in m.collect()} == {i: (0 if i < 5 else 10) for i in [*range(5), *range(10, 15)]}
    assert graph.modularity(e, m).first().q > 0.4
    x = spark.createDataFrame([(1, i % 2, i % 2) for i in range(10)], "g int, p int, q int")
    assert graph.adjusted_rand(x, "p", "q", ["g"]).first().ari == 1.0


def test_fuse_degrades_to_one_space(spark):
    s = spark.createDataFrame([(1, 2, 1.0), (2, 3, 3.0)], "a int, b int, z double")
    r = {(x.a, x.b): (x.provenance, x.strength) for x in simgraph.fuse(s, s.limit(0)).collect()}
    assert r == {(1, 2): ("sparse", 0.0), (2, 3): ("sparse", 1.0)}
    r = {(x.a, x.b): x.provenance for x in simgraph.fuse(s, s.filter("a = 1")).collect()}
    assert r == {(1, 2): "both", (2, 3): "sparse"}


def test_resolution_of_names(spark):
    d = spark.createDataFrame([("neural network",), ("neural networks",), ("Neural  network",), ("graph",), (None,), ("other thing",)], "n string")
    r = {x.name: x.canonical for x in entities.resolve(d, "n").collect()}
    assert r == {"neural network": "neural networks", "neural networks": "neural networks", "graph": "graph", "other thing": "other thing"}


def test_acronyms_and_matches(spark):
    d = spark.createDataFrame([(1, "We use Latent Semantic Analysis (LSA) here. No match (XYZ)."), (2, None)], "id int, t string")
    assert [tuple(r) for r in entities.acronym_pairs(d, "id", "t").collect()] == [("LSA", "latent semantic analysis", 1)]
    inv = spark.createDataFrame([("semantic analysis",), ("latent semantic analysis",), (None,)], "s string")
    assert [tuple(r) for r in entities.match_inventory(d, "id", "t", inv, "s").collect()] == [(1, "latent semantic analysis", 1)]


def _filled(room, amount):
    """Units one at a time, each to the emptiest open stratum."""
    got = dict.fromkeys(room, 0)
    for _ in range(min(amount, sum(room.values()))):
        c = min((c for c in room if got[c] < room[c]), key=lambda c: (got[c], c))
        got[c] += 1
    return got


def test_allocation(spark):
    rnd = random.Random(4)
    for _ in range(4):
        room = {c: rnd.randrange(0, 30) for c in range(6)}
        amount = rnd.randrange(0, 120)
        st = spark.createDataFrame([(c, r, rnd.random() * 5) for c, r in room.items()], "cid int, room long, w double")
        assert {r.cid: r.n for r in A.evenly(st, "room", amount, "n").collect()} == _filled(room, amount)
        got = A.by_weight(st, "room", "w", amount, 0.2, "n").collect()
        assert sum(r.n for r in got) == min(amount, sum(room.values())) and all(0 <= r.n <= r.room for r in got)
    st = spark.createDataFrame([(1, 50, 3.0), (2, 50, 1.0), (3, 2, 9.0), (4, 9, 0.0)], "cid int, room long, w double")
    got = {r.cid: r.n for r in A.by_weight(st, "room", "w", 20, 0.2, "n").collect()}
    assert got == {1: 12, 2: 5, 3: 2, 4: 1}
    assert sum(r.n for r in A.by_weight(st, "room", "w", 110, 0.0, "n").collect()) == 110
    lo, hi = A.kept_totals(100, 20, 5, 0.05)
    assert lo <= 25 <= hi and A.kept_totals(10, 10, 4, 0.05) == (4, 4) and A.kept_totals(7, 0, 0, 0.05) == (0, 7)
    for big, n, k in ((40, 13, 0), (40, 13, 13), (57, 20, 7)):
        ok = [t for t in range(k, big - n + k + 1) if (n + 1) * math.comb(t, k) * math.comb(big - t, n - k) / math.comb(big, n) > 0.05]
        assert A.kept_totals(big, n, k, 0.05) == (ok[0], ok[-1])


def test_estimate_of_a_census(spark):
    s = spark.createDataFrame([(1, 10, 10, 4, 1), (2, 20, 20, 6, 0)], "cid int, pop long, n long, yes long, unsure long")
    assert tuple(A.stratified(s).first()) == (10.5, 10.0, 11.0)


def test_suppression(spark):
    d = spark.createDataFrame([(1, "graph", 9.0), (1, "graphs", 8.0), (1, "node", 8.0), (2, "x", 1.0)], "c int, t string, s double")
    assert sorted((r.c, r.t, r["rank"]) for r in communities.suppress_contained(d, "c", "t", "s", 5).collect()) == [(1, "graph", 1), (1, "node", 2), (2, "x", 1)]


def test_rank_sum_equals_brute_force(spark):
    rnd = random.Random(4)
    mem = [(i, i % 2) for i in range(30)]
    w = [(i, "t", round(rnd.random(), 1)) for i in range(30) if rnd.random() < 0.7]
    W, M = spark.createDataFrame(w, "record_id int, term string, w double"), spark.createDataFrame(mem, "record_id int, cid int")
    got = selection.rank_sum_terms(W, M, spark.createDataFrame([(0, "t")], "cid int, term string")).first().auc
    v = {i: 0.0 for i, _ in mem} | {i: x for i, _, x in w}
    pairs = [(v[a], v[b]) for a, ca in mem for b, cb in mem if ca == 0 and cb == 1]
    assert abs(got - sum((x > y) + (x == y) / 2 for x, y in pairs) / len(pairs)) < 1e-6


def test_builds_are_published_last(spark, tmp_path):
    root = str(tmp_path)
    d = spark.range(5)
    assert lifecycle.live_build(spark, root) is None
    lifecycle.publish(spark, root, "b1", {"node": d}, {"node": 5})
    with pytest.raises(ValueError):
        lifecycle.publish(spark, root, "b2", {"node": d}, {"node": 6})
    assert lifecycle.live_build(spark, root) == "b1"


def test_constraints(spark):
    runs = spark.createDataFrame([("r1", "l", 12, None), ("r2", "l", 9, None)], "run_id string, label string, n_chunks int, superseded_at timestamp")
    nodes = spark.createDataFrame([("r1", i) for i in range(3)], "run_id string, ord int")
    e = spark.sql("SELECT * FROM VALUES ('r1', 2, 1, timestamp'2024-01-02', timestamp'2024-01-01'), ('r1', 0, 99, timestamp'2024-01-01', NULL) AS t(run_id, src, dst, valid_from, valid_to)")
    v = {r.rule: r.n for r in lifecycle.violations(nodes, e, runs).collect()}
    assert v == {"edge_canonical": 1, "edge_interval": 1, "edge_unique": 0, "dangling_edge": 1, "one_live_run": 1, "run_size": 1, "node_without_run": 0}


def test_sources(spark, tmp_path):
    for name, body in (("2401_00001v1", "old"), ("2401_00001v2", "new\ndata:image/png;base64,xx"), ("book", "text"), ("empty", " ")):
        (tmp_path / f"{name}.md").write_text(body)
    r = {x.key: (x.version, x.text.strip()) for x in corpora.markdown_corpus(spark, str(tmp_path)).collect()}
    assert r == {"2401_00001": (2, "new"), "book": (1, "text")}
    have = spark.createDataFrame([("2401_00001", 2)], "key string, version int")
    assert [x.key for x in corpora.markdown_corpus(spark, str(tmp_path), have).collect()] == ["book"]
    with pytest.raises(ValueError):
        corpora.write_graph_csv(spark.createDataFrame([(1,)], "id int"), spark.createDataFrame([(1, 2)], "a int, b int"), str(tmp_path / "g"))


def test_stream_ingest_keeps_newest(spark, tmp_path):
    src, dst, cp = (str(tmp_path / x) for x in ("src", "dst", "cp"))
    s = "k int, version int, id int, text string"
    spark.createDataFrame([(1, 1, 1, "a"), (1, 2, 2, "b"), (2, 1, 3, "c")], s).write.mode("append").parquet(src)
    ingest.ingest(spark, src, s, dst, cp, ["k"], "version", "id")
    spark.createDataFrame([(1, 1, 4, "late"), (2, 2, 5, "d")], s).write.mode("append").parquet(src)
    ingest.ingest(spark, src, s, dst, cp, ["k"], "version", "id")
    got = lifecycle.newest(spark.read.parquet(dst), ["k"], "version", "id")
    assert sorted((r.k, r.text) for r in got.collect()) == [(1, "b"), (2, "d")]


def test_stream_windows_with_watermark(spark, tmp_path):
    e = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'a' AS kind, 1.0D AS value UNION ALL SELECT timestamp'2024-01-01 00:50:00', 'a', 2.0D")
    e.write.parquet(str(tmp_path / "e"))
    q = ingest.windowed_counts(spark.readStream.schema(e.schema).parquet(str(tmp_path / "e")), "ts", "kind", "1 hour").writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.n, r.total) for r in spark.sql("SELECT * FROM win").collect()] == [(2, 3.0)]


def test_empty_tables(spark):
    d = spark.createDataFrame([], "id int, text string")
    assert lexical.weights(lexical.postings(d, "id", "text"), "id").count() == 0
    assert segment.structural_tokens(d, "id", "text").count() == 0 and segment.section_chunks(d.withColumn("t", F.lit("")), "id", "t", "text", 100, 10).count() == 0
    assert graph.components(d.select(F.col("id").alias("a"), F.col("id").alias("b")), d.select("id")).count() == 0


def test_token_corpus_is_one_pass_without_a_join(spark, tmp_path):
    from sectloom.plans import q_text

    text = ["# Head one\n\nSome words here. Some more words [1] after, $x$ and here.\n\n| a cell | b cell |\nwords", "Words again. Dr. Who words.", None, ""]
    rows = [(1, "p", text[0]), (2, "p", text[1]), (3, "q", text[1]), (4, None, text[1]), (5, "q", text[2]), (6, "q", text[3])]
    d = spark.createDataFrame(rows, "record_id long, doc_id string, text string")
    d.write.parquet(f"{tmp_path}/sect_node.parquet")
    want = segment.structural_tokens(d, "record_id", "text").join(d.select("record_id", "doc_id"), "record_id").groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n_tokens"), F.countDistinct("fold").alias("n_types"), F.countDistinct("record_id", "seg").alias("n_segments"))
    r = q_text.t04(spark, str(tmp_path))
    plan = r._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Expand" not in plan
    assert {tuple(x) for x in r.collect()} == {tuple(x) for x in want.collect()}
