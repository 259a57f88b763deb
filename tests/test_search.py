"""Composed searches, block products, consensus and cuts against brute force and on dirty input."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sectloom.operators import dense, graph, lexical, search, simgraph


def _hits(spark, rows):
    return spark.createDataFrame(rows, "q long, d long, source string, score double")


def test_anchors_add_one_competitive_extra_a_source(spark):
    h = _hits(spark, [(1, 1, "a", 9.0), (1, 2, "a", 8.0), (1, 3, "b", 7.0), (1, 4, "c", 4.0), (1, 5, "c", 3.9), (1, 6, "d", 3.0), (1, 7, None, 6.9), (2, 8, None, 1.0)])
    got = sorted((r.q, r.d, r.extra) for r in search.anchors(h, "q", "d", 3, 8).collect())
    assert got == [(1, 1, False), (1, 2, False), (1, 3, False), (1, 4, True), (2, 8, False)]
    assert search.anchors(h.limit(0), "q", "d", 3, 8).count() == 0
    assert search.anchors(h, "q", "d", 3, 3).filter("extra").count() == 0


def test_router_prefers_the_source_that_uses_the_terms(spark):
    post = spark.createDataFrame([("a", "x", 50), ("a", "y", 50), ("b", "x", 1), ("b", "z", 99), (None, "x", 7)], "source string, term string, tf long")
    terms = spark.createDataFrame([(1, "x"), (1, "x"), (2, "nowhere"), (3, "z")], "q long, term string")
    w = {(r.q, r.source): r.weight for r in search.router(terms, post, "q").collect()}
    assert set(w) == {(1, "a"), (1, "b"), (3, "a"), (3, "b")} and w[1, "a"] > 0.99 and w[3, "b"] > 0.99
    lo = {s: math.log(((o + 0.5) / 100.5) / (51 / 200)) for s, o in (("a", 50), ("b", 1))}
    e = {s: math.exp((v - lo["a"]) / 0.2) for s, v in lo.items()}
    assert abs(w[1, "a"] - e["a"] / sum(e.values())) < 1e-9


def test_ring_fills_quotas_then_goes_by_score(spark):
    """Mix 2 : 1 of 24 gives 16 and 8; a source that runs short leaves its places to the best of all."""
    w = spark.createDataFrame([(1, "wiki", 2 / 3), (1, "quotes", 1 / 3)], "q long, source string, weight double")
    q = {r.source: r.quota for r in search.quotas(w, "q", 24).collect()}
    assert q == {"wiki": 16, "quotes": 8}
    c = _hits(spark, [(1, i, "wiki", 100.0 - i) for i in range(40)] + [(1, 100 + i, "quotes", 10.0 - i) for i in range(3)] + [(1, 200, None, 500.0)])
    got = [(r.d, r.source) for r in search.ring(c, search.quotas(w, "q", 24), "q", "d", 24).collect()]
    assert len(got) == 24 and sum(s == "quotes" for _, s in got) == 3 and (200, None) in got and sum(s == "wiki" for _, s in got) == 20


def test_pool_of_hops_never_returns(spark):
    e = [(0, 1, 0.9), (0, 2, 0.8), (1, 3, 0.7), (2, 3, 0.6), (3, 4, 0.5), (1, 0, 0.9)]
    d = spark.createDataFrame([(7, a, b, s) for a, b, s in e + [(b, a, s) for a, b, s in e]], "build_id long, a int, b int, s double")
    s = spark.createDataFrame([(7, 0)], "build_id long, node int")
    got = {r.node: (r.hop, r.weight) for r in search.hop_pool(d, s, ["build_id"], 3, 5, 12).collect()}
    assert got == {1: (1, 0.9), 2: (1, 0.8), 3: (2, 0.7), 4: (3, 0.5)}


def test_whole_units_skip_what_does_not_fit(spark):
    u = spark.createDataFrame([(1, 1, 10, 900), (1, 2, 20, 300), (1, 3, 30, 90), (2, 1, 40, 5000), (3, 1, 50, None)], "q long, rank int, d long, n long")
    got = sorted((r.q, r.d, r.used) for r in search.pack_whole(u.fillna(0), "q", "d", F.col("n"), 1000).collect())
    assert got == [(1, 10, 900), (1, 30, 990), (2, 40, 5000), (3, 50, 0)]


def test_affinity_is_a_mean_over_known_terms(spark):
    c = spark.createDataFrame([(1, "x", 10.0), (2, "x", 5.0), (2, "y", 4.0)], "cid int, term string, g2 double")
    t = spark.createDataFrame([(9, "x"), (9, "y"), (9, "none")], "q long, term string")
    got = {r.cid: r.affinity for r in search.term_affinity(t, c, "q").collect()}
    assert got == {1: 0.5, 2: 0.75}


def test_sparse_block_products_equal_brute_force(spark):
    rnd = random.Random(3)
    rows = {k: {f"t{rnd.randrange(30)}": rnd.random() for _ in range(6)} for k in range(90)}
    rows = {k: {t: v / math.sqrt(sum(x * x for x in r.values())) for t, v in r.items()} for k, r in rows.items()}
    d = spark.createDataFrame([(k, t, v) for k, r in rows.items() for t, v in r.items()], "id long, term string, u double")
    s = {(a, b): round(sum(v * rows[b].get(t, 0) for t, v in rows[a].items()), 6) for a in rows for b in rows if a != b}
    want = {a: sorted((b for b in rows if b != a and s[a, b] > 0), key=lambda b: (-s[a, b], b))[:5] for a in rows}
    orig = lexical.block_cosines
    got = {}
    for r in lexical.nearest_rows(d, "id", 5).orderBy("a", "rank").collect():
        got.setdefault(r.a, []).append(r.b)
    assert got == want
    links = {r.id: r.links for r in lexical.count_links(d, "id", 0.3).collect()}
    assert links == {a: sum(s[a, b] >= 0.3 for b in rows if b != a) for a in rows}
    small = orig(d, "id", lambda s, a, b: __import__("pandas").DataFrame({"n": [int(np.isfinite(s).sum())]}), "n long", block=20)
    assert small.agg(F.sum("n")).first()[0] == 90 * 89


def test_counts_and_strongest_pairs(spark):
    g = np.random.default_rng(1)
    x = g.normal(size=(60, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[7] = x[8] = x[9]
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    s = np.round(x @ x.T, 6)
    pairs = sorted(((-s[i, j], i, j) for i in range(60) for j in range(i + 1, 60)))
    assert dense.similarity_counts(d, "id", "v", 2).agg(F.sum("n")).first()[0] == 60 * 59 // 2
    for k in (1, 2, 50):
        assert {(r.a, r.b) for r in dense.strongest_pairs(d, "id", "v", k).collect()} == {(i, j) for _, i, j in pairs[:k]}
    assert dense.strongest_pairs(d.limit(0), "id", "v", 5).count() == 0


def test_cells_find_most_neighbours(spark):
    g = np.random.default_rng(2)
    x = np.repeat(g.normal(size=(20, 12)), 30, 0) + g.normal(size=(600, 12)) * 0.3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    s = x @ x.T
    np.fill_diagonal(s, -9)
    want = {i: set(np.argsort(-s[i])[:5].tolist()) for i in range(600)}
    got = {}
    for r in dense.cell_topk(d, "id", "v", 5, cells=20, probe=4, most=16).collect():
        got.setdefault(r.query, set()).add(r.id)
    assert np.mean([len(got[i] & want[i]) / 5 for i in want]) >= 0.9


def test_null_cut_inverts_its_scale(spark):
    rnd = random.Random(5)
    v = [round(min(0.99, max(0.03, rnd.gauss(0.3, 0.08))), 4) for _ in range(3000)]
    c = spark.createDataFrame([(x,) for x in v], "s double").groupBy("s").count().withColumnRenamed("count", "n")
    r = simgraph.null_cut(c, 2.0).first()
    x = np.array(v) - r.xmin + 1e-3
    y = np.log(x) if abs(r.lam) < 1e-9 else (x**r.lam - 1) / r.lam
    assert r.n == 3000 and abs(y.mean() - r.mu) < 1e-6 and abs(y.std() - r.sd) < 1e-6
    t = r.threshold - r.xmin + 1e-3
    z = ((math.log(t) if abs(r.lam) < 1e-9 else (t**r.lam - 1) / r.lam) - r.mu) / r.sd
    assert abs(z - 2) < 1e-6 and 0.01 < np.mean(np.array(v) > r.threshold) < 0.05


def _cliques(spark, n=4, size=6):
    e = [(1, c * size + i, c * size + j, 1.0) for c in range(n) for i in range(size) for j in range(i + 1, size)]
    e += [(1, c * size, (c + 1) * size, 0.1) for c in range(n - 1)]
    return spark.createDataFrame(e, "build_id long, a int, b int, s double")


def test_consensus_and_sweep(spark):
    e = _cliques(spark)
    c = {r.id: r.cid for r in graph.consensus(e, ["build_id"], [1, 2, 3]).collect()}
    assert len(c) == 24 and all(c[i] == (i // 6) * 6 for i in range(24))
    w = graph.seed_agreement(e, ["build_id"], [0.5, 1.0, 1.5], [1, 2]).collect()
    assert {r.resolution: r.communities for r in w}[1.0] == 4 and all(0.99 < r.ari <= 1 for r in w if r.resolution == 1.0)


def test_oversize_communities_are_divided_inside(spark):
    e = _cliques(spark, 4, 6)
    one = spark.createDataFrame([(1, i, 0) for i in range(24)], "build_id long, id long, cid long")
    got = {r.id: (r.cid, r.coarse) for r in graph.split_oversize(e, one, ["build_id"]).collect()}
    assert all(got[i] == ((i // 6) * 6, 0) for i in range(24))
    small = spark.createDataFrame([(1, i, (i // 6) * 6) for i in range(24)], "build_id long, id long, cid long")
    assert all(r.cid == r.coarse for r in graph.split_oversize(e, small, ["build_id"]).collect())


def test_plateau_is_the_longest_flat_stretch():
    sweep = [(0.2, 4, 0.90), (0.4, 9, 0.30), (0.6, 20, 0.700), (0.8, 30, 0.701), (1.0, 42, 0.702), (1.2, 60, 0.5)]
    # successive differences deviate by 0.203 in the median, so a stretch may vary by 0.301
    assert graph.plateau(sweep, 31) == 0.8 and graph.plateau(sweep, 100) == 1.2 and graph.plateau(sweep, 1) == 0.6
    assert graph.plateau([(1.0, 5, 0.5)], 9) == 1.0


def test_cheapest_paths_have_no_limit_of_hops(spark):
    e = spark.createDataFrame([(1, i, i + 1, 0.9) for i in range(15)], "build_id long, a int, b int, s double")
    y = e.unionByName(e.select("build_id", F.col("b").alias("a"), F.col("a").alias("b"), "s"))
    s = spark.createDataFrame([(1, 0)], "build_id long, seed int")
    c = {r.node: r.cost for r in graph.cheapest_paths(y, s, 0.0).collect()}
    assert len(c) == 16 and abs(c[15] + 15 * math.log(0.9)) < 1e-9


@pytest.mark.parametrize("name", ["c01_section_communities", "c03_consensus", "c05_plateau_pick", "c06_consensus_gate", "c07_oversize_split", "c28_subgraph_communities", "d06_cell_knn", "g10_null_cut", "a27_semantic_tally"])
def test_queries_without_sql_run(spark, name):
    from sectloom.plans.catalog import CORE

    assert CORE.queries[name](spark, "/root/testdata/sf0.001").count() > 0


def test_truth_ranks_equal_brute_force_and_write_no_hits(spark, tmp_path, monkeypatch):
    from sectloom.plans import q_lexical

    rnd = random.Random(5)
    names = [f"name{i}" for i in range(60)]
    text = [" ".join(["shared"] * rnd.randrange(1, 4) + [names[i]] * (i % 3) + rnd.choices(names, k=4)) for i in range(60)]
    text[7] = "nothing here"
    spark.createDataFrame([(i, f"Shared heading words {names[i]}", text[i]) for i in range(60)], "record_id long, section_title string, text string").write.parquet(f"{tmp_path}/sect_node.parquet")
    written, cut = [], q_lexical.cut
    for module in (q_lexical, lexical):
        monkeypatch.setattr(module, "cut", lambda df, label="cut": (out := cut(df, label), written.append(out.count()))[0])
    got = {r.gold: r.better for r in q_lexical.l25(spark, str(tmp_path)).collect()}
    docs = [t.split() for t in text]
    avg = sum(map(len, docs)) / 60

    def score(q, t):
        s = 0.0
        for w in {"shared", "heading", "words", q} & set(t):
            df, tf = sum(w in d for d in docs), t.count(w)
            s += math.log(1 + (60 - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / avg))
        return round(s, 6)

    s = [[score(q, d) for d in docs] for q in names]
    assert got == {i: sum(x > s[i][i] for x in s[i]) for i in range(60) if i != 7}
    assert max(written) < 300  # 59 x 60 hits
    rows = lexical.document_tokens(spark.read.parquet(f"{tmp_path}/sect_node.parquet"), "record_id", "text")
    q = spark.createDataFrame([(i, w) for i in range(60) for w in ("shared", "heading", "words", names[i])], "gold long, term string")
    assert {r.gold: r.better for r in lexical.truth_ranks(rows, "record_id", q, "gold", 7, 9).filter("truth IS NOT NULL").collect()} == got


def test_bootstrap_without_titles(spark, tmp_path):
    from sectloom.plans import q_lexical

    spark.createDataFrame([(1, "short", "some text"), (2, None, None)], "record_id long, section_title string, text string").write.parquet(f"{tmp_path}/sect_node.parquet")
    assert q_lexical.a18b(spark, str(tmp_path)).count() == 0 and q_lexical.l25(spark, str(tmp_path)).count() == 0


def test_overlapping_sets_equal_brute_force(spark):
    rnd = random.Random(9)
    base = [rnd.sample(range(3000), 30) for _ in range(12)]
    sets = {f"s{k}": sorted(set(rnd.sample(base[k % 12], rnd.randrange(10, 30)) + rnd.sample(range(3000), 5))) for k in range(150)} | {"empty": [], "twin": sorted(set(base[0])), "twin2": sorted(set(base[0]))}
    d = spark.createDataFrame(list(sets.items()), "k string, h array<long>")
    want = {}
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = set(sets[a]), set(sets[b])
        if x and y and len(x & y) / len(x | y) >= 0.5:
            want[a, b] = len(x & y) / len(x | y)
    for block in (8192, 20):
        got = lexical.overlapping_sets(d, "k", "h", 0.5, block).collect()
        assert len(got) == len(want) and {(r.a, r.b): r.s for r in got} == want


def test_trigram_matches_join_no_titles(spark, tmp_path):
    """Titles that all share their trigrams are counted in blocks; a join on trigrams would make all their pairs."""
    from sectloom.plans import q_lexical

    spark.createDataFrame([(i, f"common heading {i}") for i in range(40)] + [(90, None), (91, "")], "record_id long, section_title string").write.parquet(f"{tmp_path}/sect_node.parquet")
    r = q_lexical.l22(spark, str(tmp_path))
    assert "Join" not in r._jdf.queryExecution().optimizedPlan().toString()
    got = r.collect()
    assert len(got) == 40 * 39 and {(x.query, x.title) for x in got} == {(y.title, y.query) for y in got}


def test_nearest_documents_equal_brute_force_without_moving_rows(spark, tmp_path, monkeypatch):
    from sectloom.plans import q_dense
    from tests.oracle import norm
    import duckdb

    rnd = random.Random(11)
    words = [f"word{i}" for i in range(400)]
    text = [" ".join(rnd.choices(words[:12], k=6) + rnd.choices(words, k=8)) for _ in range(220)] + [None, "", "lonely", "of the"]
    text[9] = text[8]
    text[30] = text[31] = text[32] = text[33] = text[34] = text[35] = text[36]
    spark.createDataFrame(list(enumerate(text)), "record_id long, text string").repartition(3).write.parquet(f"{tmp_path}/sect_node.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW sect_node AS SELECT * FROM read_parquet('{tmp_path}/sect_node.parquet/*.parquet')")
    want = norm(db.execute(q_dense.CORE.sql["g13_lexical_knn"]).df())
    t = lexical.cut(lexical.document_tokens(spark.read.parquet(f"{tmp_path}/sect_node.parquet"), "record_id", "text"), "tokens")
    u = lexical.unit_documents(t, "record_id")
    for block, most in ((8192, 1024), (50, 5), (50, 0)):
        r = lexical.nearest_documents(u, "record_id", 5, block, most)
        assert "Exchange" not in r._jdf.queryExecution().executedPlan().toString()
        assert norm(r.toPandas()) == want
    assert norm(q_dense.g15(spark, str(tmp_path)).toPandas()) == norm(db.execute(q_dense.CORE.sql["g15_sparse_only"]).df())
