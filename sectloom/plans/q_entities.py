"""Entities and relations: E01-E17."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sectloom.functions import stats
from sectloom.operators import entities as E
from sectloom.operators import graph as G
from sectloom.operators import segment
from sectloom.operators.lexical import top
from sectloom.plans.base import edges, mentions, sections, symmetric
from sectloom.plans.registry import CORE
from sectloom.plans.runtime import cut, table
from sectloom.plans.sqlparts import EDGES, MENTIONS


def _tokens(spark, d):
    return cut(segment.structural_tokens(sections(spark, d), "record_id", "text").filter("kind = 'prose'"), "tokens")


@CORE("e01_ngrams")
def e01(spark, d):
    """Grams of up to four tokens that occur at least five times."""
    return E.ngrams(_tokens(spark, d), "record_id", 4, 5)


@CORE("e02_gram_features")
def e02(spark, d):
    """Cohesion and freedom of two-token grams."""
    t = _tokens(spark, d)
    return E.gram_features(t, cut(E.ngrams(t, "record_id", 2, 5), "grams"), "record_id")


@CORE("e03_scored_grams")
def e03(spark, d):
    """Two-token grams by the geometric mean of their mid-ranks in cohesion, freedom and residual idf; the 200 best (a top-k report)."""
    t = _tokens(spark, d)
    f = cut(E.gram_features(t, cut(E.ngrams(t, "record_id", 2, 5), "grams"), "record_id").withColumn("free", F.least("left_entropy", "right_entropy")), "features")
    n, out = f.count(), f
    for c in ("npmi", "free", "ridf"):
        k = f.groupBy(c).agg(F.count(F.lit(1)).alias("k"))
        w = Window.orderBy(c).rowsBetween(Window.unboundedPreceding, -1)
        mid = k.select(c, ((F.coalesce(F.sum("k").over(w), F.lit(0)) + (F.col("k") + 1) / 2) / max(1, n)).alias(f"r_{c}"))
        out = out.join(mid, c)
    s = F.exp((F.log("r_npmi") + F.log("r_free") + F.log("r_ridf")) / 3)
    return out.select("gram", "cf", F.round(s, 6).alias("score")).orderBy(F.col("score").desc(), "gram").limit(200)


@CORE("e04_acronyms")
def e04(spark, d):
    """Short forms with the words they stand for."""
    return E.acronym_pairs(table(spark, d, "documents"), "doc_id", "text")


@CORE("e05_frozen_matches")
def e05(spark, d):
    """Mentions of an inventory of grams, longest first."""
    t = _tokens(spark, d)
    inv = E.ngrams(t, "record_id", 2, 20).filter("n = 2").select("gram")
    return E.match_inventory(sections(spark, d), "record_id", "text", cut(inv, "inventory"), "gram")


@CORE("e06_context_types")
def e06(spark, d):
    """Words grouped by the company they keep: communities over positive mutual information of neighbours two words away."""
    t = _tokens(spark, d).select("record_id", "seg", "pos", "fold").filter("fold RLIKE '^[a-z]{4,}$'")
    f = t.groupBy("fold").agg(F.count(F.lit(1)).cast("double").alias("c")).filter("c >= 30")
    t = t.join(f.select("fold"), "fold", "left_semi")
    w = Window.partitionBy("record_id", "seg").orderBy("pos")
    p = t.select("fold", F.lead("fold").over(w).alias("n1"), F.lead("fold", 2).over(w).alias("n2"))
    pairs = p.select(F.col("fold").alias("x"), F.explode(F.array_compact(F.array("n1", "n2"))).alias("y")).filter("x <> y").groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.count(F.lit(1)).cast("double").alias("xy")).filter("xy >= 5")
    n = float(t.count())
    j = pairs.join(f.select(F.col("fold").alias("x"), F.col("c").alias("cx")), "x").join(f.select(F.col("fold").alias("y"), F.col("c").alias("cy")), "y")
    e = j.withColumn("s", stats.ppmi(F.col("xy"), F.col("cx"), F.col("cy"), F.lit(n))).filter("s > 1")
    ids = cut(f.select("fold").withColumn("id", F.abs(F.xxhash64("fold"))), "ids")
    e = e.join(ids.select(F.col("fold").alias("x"), F.col("id").alias("a")), "x").join(ids.select(F.col("fold").alias("y"), F.col("id").alias("b")), "y").select(F.lit(0).alias("g"), "a", "b", "s")
    return G.louvain(e, ["g"]).join(ids, "id").select(F.col("fold").alias("word"), "cid")


@CORE("e07_entity_df", sql=MENTIONS + "SELECT build_id, entity_id, count(*) AS df, CAST(sum(cnt) AS BIGINT) AS cf FROM m GROUP BY ALL")
def e07(spark, d):
    """Sections and mentions of every entity."""
    return mentions(spark, d).groupBy("build_id", "entity_id").agg(F.count(F.lit(1)).alias("df"), F.sum("cnt").alias("cf"))


_PAIR = MENTIONS + ", p AS (SELECT x.build_id, x.entity_id AS a, y.entity_id AS b, CAST(count(*) AS DOUBLE) AS ab FROM m x JOIN m y ON x.build_id = y.build_id AND x.ord = y.ord AND x.entity_id < y.entity_id GROUP BY ALL HAVING count(*) >= 5), j AS (SELECT p.*, CAST(fa.df AS DOUBLE) AS na, CAST(fb.df AS DOUBLE) AS nb, CAST(n.n AS DOUBLE) AS n FROM p JOIN f fa ON fa.build_id = p.build_id AND fa.entity_id = a JOIN f fb ON fb.build_id = p.build_id AND fb.entity_id = b JOIN n ON n.build_id = p.build_id) "


@CORE("e08_co_mention_edges", sql=_PAIR + "SELECT build_id, a, b, CAST(ab AS BIGINT) AS n_shared, round(ln(ab * n / (na * nb)) / -ln(ab / n), 6) AS npmi FROM j WHERE ab < n AND na <= 2000 AND nb <= 2000 AND round(ln(ab * n / (na * nb)) / -ln(ab / n), 9) > 0")
def e08(spark, d):
    """Edges between entities in at least five common sections with positive npmi; entities in over 2,000 sections make none."""
    p = E.pair_table(mentions(spark, d), 5, 2000)
    v = stats.npmi(F.col("ab"), F.col("na"), F.col("nb"), F.col("n"))
    return p.filter("ab < n").filter(F.round(v, 9) > 0).select("build_id", "a", "b", F.col("ab").cast("long").alias("n_shared"), F.round(v, 6).alias("npmi"))


@CORE("e09_entity_bm25", sql=MENTIONS + ", l AS (SELECT build_id, ord, sum(cnt) AS dl FROM m GROUP BY ALL), a AS (SELECT build_id, avg(dl) AS avgdl FROM l GROUP BY ALL) SELECT build_id, ord, entity_id, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * (cnt * 2.5 / (cnt + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS w FROM m JOIN f USING (build_id, entity_id) JOIN n USING (build_id) JOIN l USING (build_id, ord) JOIN a USING (build_id)")
def e09(spark, d):
    """BM25 weight of every mention, entities being the terms."""
    m = mentions(spark, d)
    l = m.groupBy("build_id", "ord").agg(F.sum("cnt").alias("dl"))
    a = l.groupBy("build_id").agg(F.avg("dl").alias("avgdl"), F.count(F.lit(1)).alias("n"))
    f = m.groupBy("build_id", "entity_id").agg(F.count(F.lit(1)).alias("df"))
    return m.join(f, ["build_id", "entity_id"]).join(l, ["build_id", "ord"]).join(a, "build_id").select("build_id", "ord", "entity_id", F.round(stats.bm25(F.col("cnt"), F.col("df"), F.col("dl"), F.col("n"), F.col("avgdl")), 6).alias("w"))


@CORE("e10_resolved_names")
def e10(spark, d):
    """Spellings of global terms joined to their canonical form."""
    return E.resolve(table(spark, d, "global_qa_term_df").filter("term IS NOT NULL"), "term", 0.9)


@CORE("e11_entity_classes")
def e11(spark, d):
    """Classes of entities: communities of the graph of pairs in at least three sections with positive npmi, named by their least member."""
    p = E.pair_table(mentions(spark, d), 3)
    v = stats.npmi(F.col("ab"), F.col("na"), F.col("nb"), F.col("n"))
    return G.louvain(p.withColumn("s", v).filter("s > 0").select("build_id", "a", "b", "s"), ["build_id"])


def _sentences(spark, d):
    s = segment.sentences(sections(spark, d), "record_id", "text")
    return s.join(sections(spark, d).select("record_id", "text"), "record_id").select("record_id", F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")).alias("sentence"))


@CORE("e13_anchors")
def e13(spark, d):
    """How often each invented or capitalised word anchors a relation."""
    r = cut(E.relation_candidates(_sentences(spark, d), "record_id"), "relations")
    return r.select(F.col("a").alias("word"), "n").unionByName(r.select(F.col("b").alias("word"), "n")).groupBy("word").agg(F.sum("n").alias("n"))


@CORE("e14_templates")
def e14(spark, d):
    """Words between two anchors, with the number of pairs and sentences."""
    return E.relation_candidates(_sentences(spark, d), "record_id").groupBy("template").agg(F.count(F.lit(1)).alias("n_pairs"), F.sum("n").alias("n"))


@CORE("e15_scored_relations")
def e15(spark, d):
    """Anchored pairs in at least three sentences and with a log-likelihood of at least 10.83, with their most usual template."""
    r = cut(E.relation_candidates(_sentences(spark, d), "record_id"), "relations")
    p = r.groupBy("a", "b").agg(F.sum("n").cast("double").alias("ab"), F.max_by("template", F.struct("n", "template")).alias("template"))
    ra, rb = r.groupBy("a").agg(F.sum("n").cast("double").alias("na")), r.groupBy("b").agg(F.sum("n").cast("double").alias("nb"))
    one = r.agg(F.sum("n").cast("double").alias("n"))
    j = p.filter("ab >= 3").join(ra, "a").join(rb, "b").crossJoin(F.broadcast(one))  # one row
    return j.select("a", "b", "template", F.col("ab").cast("long").alias("n"), F.round(stats.g2(F.col("ab"), F.col("na"), F.col("nb"), F.col("n")), 4).alias("g2")).filter("g2 >= 10.83")


@CORE("e16_template_classes")
def e16(spark, d):
    """Templates that join the same pairs: set cosine of at least 0.1 over at least three common pairs, in components."""
    r = cut(E.relation_candidates(_sentences(spark, d), "record_id").withColumn("pair", F.concat_ws("|", "a", "b")).select("template", "pair").distinct(), "pairs")
    size = r.groupBy("template").agg(F.count(F.lit(1)).alias("c"))
    x = r.select("pair", F.col("template").alias("x")).join(r.select("pair", F.col("template").alias("y")), "pair").filter("x < y").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3")
    x = x.join(size.select(F.col("template").alias("x"), F.col("c").alias("cx")), "x").join(size.select(F.col("template").alias("y"), F.col("c").alias("cy")), "y").filter("n / sqrt(cx * cy) >= 0.1")
    return G.components(cut(x.select(F.col("x").alias("a"), F.col("y").alias("b")), "edges"), size.select(F.col("template").alias("id"))).select(F.col("id").alias("template"), F.col("component").alias("class"))


_CLS = MENTIONS + """, s AS (SELECT build_id, ord, community AS cid FROM sect_node WHERE community IS NOT NULL AND community >= 0), cm AS (SELECT build_id, cid, entity_id, CAST(sum(cnt) AS BIGINT) AS mass FROM m JOIN s USING (build_id, ord) GROUP BY ALL)"""


@CORE("e17_class_labels", sql=_CLS + ", r AS (SELECT build_id, cid, entity_id, round(mass * ln(n / df), 6) AS score, row_number() OVER (PARTITION BY build_id, cid ORDER BY round(mass * ln(n / df), 6) DESC, entity_id) AS rank FROM cm JOIN f USING (build_id, entity_id) JOIN n USING (build_id)) SELECT build_id, cid, entity_id, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5")
def e17(spark, d):
    """The five entities of each community with the largest mass times idf."""
    m = mentions(spark, d)
    s = sections(spark, d).filter("community IS NOT NULL AND community >= 0").select("build_id", "ord", F.col("community").alias("cid"))
    cm = m.join(s, ["build_id", "ord"]).groupBy("build_id", "cid", "entity_id").agg(F.sum("cnt").alias("mass"))
    f = m.groupBy("build_id", "entity_id").agg(F.count(F.lit(1)).alias("df"))
    n = m.groupBy("build_id").agg(F.countDistinct("ord").alias("n"))
    x = cm.join(f, ["build_id", "entity_id"]).join(n, "build_id").select("build_id", "cid", "entity_id", F.round(F.col("mass") * F.log(F.col("n") / F.col("df")), 6).alias("score"))
    return top(x, ["build_id", "cid"], [F.col("score").desc(), F.col("entity_id")], 5)
