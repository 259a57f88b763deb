"""Statistics and corpus-wide counts: A01-A34."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sectloom.functions import stats
from sectloom.functions.text import tokenize
from sectloom.operators import aggregate as A
from sectloom.operators import boxcox, lexical
from sectloom.plans.base import edges, mentions, post, sections
from sectloom.plans.registry import CORE
from sectloom.plans.runtime import cut, table
from sectloom.plans.sqlparts import EDGES, MENTIONS, POST, tokens


def boxcox_sql(x: str) -> str:
    """Tables bc0, bc1, bc2 (g, lam) of the best power on ever finer grids, from a table ``x`` (g, x)."""
    out = []
    for i, grid in enumerate(("SELECT g, x, lam FROM {x}, (SELECT unnest(range(-300, 301, 25)) / 100.0 AS lam)", "SELECT g, x, round(lam + i * 0.025, 4) AS lam FROM {x} JOIN bc0 USING (g), (SELECT unnest(range(-10, 11)) AS i)", "SELECT g, x, round(lam + i * 0.0025, 4) AS lam FROM {x} JOIN bc1 USING (g), (SELECT unnest(range(-10, 11)) AS i)")):
        out.append(f"""bc{i} AS (SELECT g, lam FROM (SELECT g, CAST(lam AS DOUBLE) AS lam, row_number() OVER (PARTITION BY g ORDER BY round((lam - 1) * sl - n / 2 * ln(greatest(v, 1e-300)), 6) DESC, abs(lam - 1), lam) AS r
FROM (SELECT g, lam, count(*) AS n, sum(ln(x)) AS sl, var_pop(CASE WHEN lam = 0 THEN ln(x) ELSE (pow(x, lam) - 1) / lam END) AS v FROM ({grid.format(x=x)}) GROUP BY ALL)) WHERE r = 1)""")
    return ", ".join(out)


@CORE("a01_boxcox_power", sql="WITH x AS (SELECT source AS g, CAST(length(text) AS DOUBLE) AS x FROM documents WHERE length(text) > 0 AND source IS NOT NULL), " + boxcox_sql("x") + ", c AS (SELECT g, count(*) AS n FROM x GROUP BY g) SELECT g AS source, lam, n FROM bc2 JOIN c USING (g) WHERE n >= 20")
def a01(spark, d):
    """Box-Cox power of document lengths by source, by likelihood, for sources of at least 20 documents."""
    x = table(spark, d, "documents").filter("length(text) > 0 AND source IS NOT NULL").select(F.col("source").alias("g"), F.length("text").cast("double").alias("x"))
    n = x.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    return boxcox.powers(x, "g").join(n, "g").filter("n >= 20").select(F.col("g").alias("source"), "lam", "n")


@CORE("a02_robust_bands", sql=MENTIONS + ", s AS (SELECT build_id, ord, CAST(sum(cnt) AS BIGINT) AS x FROM m GROUP BY ALL), d AS (SELECT build_id, median(x) AS med FROM s GROUP BY ALL) SELECT build_id, any_value(med) AS med, median(abs(x - med)) AS mad, any_value(med) + 2 * 1.4826 * median(abs(x - med)) AS hi FROM s JOIN d USING (build_id) GROUP BY build_id")
def a02(spark, d):
    """Median, median deviation and upper band of mentions per section."""
    s = mentions(spark, d).groupBy("build_id", "ord").agg(F.sum("cnt").alias("x"))
    m = s.groupBy("build_id").agg(F.median("x").alias("med"))
    return s.join(m, "build_id").groupBy("build_id").agg(F.first("med").alias("med"), F.median(F.abs(F.col("x") - F.col("med"))).alias("mad")).withColumn("hi", F.col("med") + 2 * 1.4826 * F.col("mad"))


_G2 = "2 * (CASE WHEN a > 0 THEN a * ln(a * n / (r * c)) ELSE 0 END + CASE WHEN r - a > 0 THEN (r - a) * ln((r - a) * n / (r * (n - c))) ELSE 0 END + CASE WHEN c - a > 0 THEN (c - a) * ln((c - a) * n / ((n - r) * c)) ELSE 0 END + CASE WHEN n - r - c + a > 0 THEN (n - r - c + a) * ln((n - r - c + a) * n / ((n - r) * (n - c))) ELSE 0 END)"
_CT = POST + """, s AS (SELECT record_id, community AS cid FROM sect_node WHERE community IS NOT NULL AND community >= 0), sz AS (SELECT cid, CAST(count(*) AS DOUBLE) AS r FROM s GROUP BY cid), nd AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM s),
td AS (SELECT term, CAST(count(*) AS DOUBLE) AS c FROM post JOIN s USING (record_id) GROUP BY term), x AS (SELECT cid, term, CAST(count(*) AS DOUBLE) AS a FROM post JOIN s USING (record_id) GROUP BY ALL), g AS (SELECT * FROM x JOIN sz USING (cid) JOIN td USING (term), nd) """


def _community_table(spark, d):
    """(cid, term, a, r, c, n): sections of the community with the term, its size, the term's sections, all sections."""
    s = sections(spark, d).filter("community IS NOT NULL AND community >= 0").select("record_id", F.col("community").alias("cid"))
    p = cut(post(spark, d).join(s, "record_id"), "members")
    x = p.groupBy("cid", "term").agg(F.count(F.lit(1)).cast("double").alias("a"))
    r = s.groupBy("cid").agg(F.count(F.lit(1)).cast("double").alias("r"))
    c = p.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("c"))
    return x.join(r, "cid").join(c, "term").crossJoin(F.broadcast(s.agg(F.count(F.lit(1)).cast("double").alias("n"))))  # one row


@CORE("a03_dunning", sql=_CT + f"SELECT cid, term, round({_G2}, 4) AS g2 FROM g WHERE a >= 3")
def a03(spark, d):
    """Log-likelihood ratio of every term in every community."""
    return _community_table(spark, d).filter("a >= 3").select("cid", "term", F.round(stats.g2(F.col("a"), F.col("r"), F.col("c"), F.col("n")), 4).alias("g2"))


@CORE("a04_llr_gate", sql=_CT + f"SELECT cid, count(*) AS kept FROM g WHERE a * n > r * c AND round({_G2}, 6) >= 10.83 GROUP BY cid")
def a04(spark, d):
    """Terms of each community that pass the likelihood gate."""
    return _community_table(spark, d).filter("a * n > r * c").filter(F.round(stats.g2(F.col("a"), F.col("r"), F.col("c"), F.col("n")), 6) >= 10.83).groupBy("cid").agg(F.count(F.lit(1)).alias("kept"))


@CORE("a05_keyness_ratio", sql=_CT + "SELECT cid, term, round(log2(((a + 0.5) / (r + 1)) / ((c - a + 0.5) / (n - r + 1))), 6) AS keyness FROM g WHERE a >= 2")
def a05(spark, d):
    """Log ratio of a term's rate in a community to its rate elsewhere, smoothed."""
    k = F.log2(((F.col("a") + 0.5) / (F.col("r") + 1)) / ((F.col("c") - F.col("a") + 0.5) / (F.col("n") - F.col("r") + 1)))
    return _community_table(spark, d).filter("a >= 2").select("cid", "term", F.round(k, 6).alias("keyness"))


_PAIR = MENTIONS + ", p AS (SELECT x.build_id, x.entity_id AS a, y.entity_id AS b, CAST(count(*) AS DOUBLE) AS ab FROM m x JOIN m y ON x.build_id = y.build_id AND x.ord = y.ord AND x.entity_id < y.entity_id GROUP BY ALL HAVING count(*) >= 3), j AS (SELECT p.*, CAST(fa.df AS DOUBLE) AS na, CAST(fb.df AS DOUBLE) AS nb, CAST(n.n AS DOUBLE) AS n FROM p JOIN f fa ON fa.build_id = p.build_id AND fa.entity_id = a JOIN f fb ON fb.build_id = p.build_id AND fb.entity_id = b JOIN n ON n.build_id = p.build_id) "


@CORE("a06_pmi", sql=_PAIR + "SELECT build_id, a, b, round(CASE WHEN ab >= n THEN 0 ELSE ln(ab * n / (na * nb)) / -ln(ab / n) END, 6) AS npmi, round(CASE WHEN ab >= n THEN 0 ELSE greatest(0, log2(ab * n / (na * nb))) END, 6) AS ppmi FROM j")
def a06(spark, d):
    """Normalised and positive mutual information of entity pairs in at least three sections."""
    from sectloom.operators.entities import pair_table

    c = [F.col(x) for x in ("ab", "na", "nb", "n")]
    return pair_table(mentions(spark, d), 3).select("build_id", "a", "b", F.round(stats.npmi(*c), 6).alias("npmi"), F.round(stats.ppmi(*c), 6).alias("ppmi"))


@CORE("a07_group_entropy", sql=_CT + ", e AS (SELECT term, a / sum(a) OVER (PARTITION BY term) AS p FROM g) SELECT term, round(-sum(p * log2(p)), 6) AS bits FROM e GROUP BY term")
def a07(spark, d):
    """Entropy of each term over communities, in bits."""
    t = _community_table(spark, d)
    tot = t.groupBy("term").agg(F.sum("a").alias("t"))
    p = F.col("a") / F.col("t")
    return t.join(tot, "term").groupBy("term").agg(F.round(-F.sum(p * F.log2(p)), 6).alias("bits"))


@CORE("a08_mid_rank", sql=POST + ", r AS (SELECT term, df, row_number() OVER (ORDER BY df, term) AS r, count(*) OVER () AS n FROM df) SELECT df, round(avg(r) / any_value(n), 8) AS mid_rank FROM r GROUP BY df")
def a08(spark, d):
    """Mean rank of each document frequency among all, as a share; from counts of equal values, so nothing is sorted whole."""
    f = lexical.doc_freq(post(spark, d)).groupBy("df").agg(F.count(F.lit(1)).alias("k"))
    w = Window.orderBy("df").rowsBetween(Window.unboundedPreceding, -1)  # one row a distinct frequency
    b = f.withColumn("before", F.coalesce(F.sum("k").over(w), F.lit(0)))
    total = f.agg(F.sum("k").alias("n"))
    return b.crossJoin(F.broadcast(total)).select("df", F.round((F.col("before") + (F.col("k") + 1) / 2) / F.col("n"), 8).alias("mid_rank"))


@CORE("a09_residual_idf", sql=POST + "SELECT term, round(-log2(df / n) + log2(1 - exp(-CAST(cf AS DOUBLE) / n)), 6) AS ridf FROM df, nn")
def a09(spark, d):
    """Residual idf of every term."""
    p = post(spark, d)
    return lexical.doc_freq(p).crossJoin(F.broadcast(lexical.corpus_size(p, "record_id"))).select("term", F.round(stats.residual_idf(F.col("df"), F.col("cf"), F.col("n")), 6).alias("ridf"))


@CORE("a10_cross_entropy", sql=POST + """, pt AS (SELECT doc_id, term, CAST(sum(tf) AS DOUBLE) AS tf FROM post JOIN sect_node USING (record_id) GROUP BY ALL), pl AS (SELECT doc_id, sum(tf) AS l FROM pt GROUP BY doc_id), ct AS (SELECT term, sum(tf) AS cf FROM pt GROUP BY term), tot AS (SELECT sum(tf) AS t, count(DISTINCT term) AS v FROM pt)
SELECT doc_id, round(-sum(tf / l * log2((cf - tf + 1) / (t - l + v))), 6) AS bits FROM pt JOIN pl USING (doc_id) JOIN ct USING (term), tot GROUP BY doc_id""")
def a10(spark, d):
    """Leave-one-out cross-entropy of every paper against the others, add-one smoothed."""
    pt = cut(post(spark, d).join(sections(spark, d).select("record_id", "doc_id"), "record_id").groupBy("doc_id", "term").agg(F.sum("tf").cast("double").alias("tf")), "pt")
    l, c = pt.groupBy("doc_id").agg(F.sum("tf").alias("l")), pt.groupBy("term").agg(F.sum("tf").alias("cf"))
    one = c.agg(F.sum("cf").alias("t"), F.count(F.lit(1)).alias("v"))
    j = pt.join(l, "doc_id").join(c, "term").crossJoin(F.broadcast(one))  # one row
    return j.groupBy("doc_id").agg(F.round(-F.sum(F.col("tf") / F.col("l") * F.log2((F.col("cf") - F.col("tf") + 1) / (F.col("t") - F.col("l") + F.col("v")))), 6).alias("bits"))


@CORE("a11_term_bands", sql=POST + ", s AS (SELECT term, any_value(df) AS df, round(log2(max(w) * sqrt(any_value(df))), 6) AS score FROM wt GROUP BY term), h AS (SELECT df, count(*) AS k FROM s GROUP BY df), c AS (SELECT df, CAST(least(8, floor(8 * (sum(k) OVER (ORDER BY df) - k) / sum(k) OVER ()) + 1) AS INT) AS band FROM h) SELECT band, count(*) AS n, min(df) AS lo, max(df) AS hi, round(avg(score) + stddev_samp(score), 4) AS bound FROM s JOIN c USING (df) GROUP BY band")
def a11(spark, d):
    """Terms in up to eight bands of document frequency, about equal in number, with the score bound of each. Terms of one frequency
    stay together (bands that it fills are merged), so bands follow from the counts of each frequency alone."""
    s = lexical.weights(post(spark, d), "record_id").groupBy("term").agg(F.first("df").alias("df"), F.max("w").alias("m")).withColumn("score", F.round(F.log2(F.col("m") * F.sqrt("df")), 6))
    s = cut(s, "scores")
    h = s.groupBy("df").agg(F.count(F.lit(1)).alias("k"))  # a row a frequency
    below = F.sum("k").over(Window.orderBy("df")) - F.col("k")
    c = h.select("df", F.least(F.lit(8), F.floor(8 * below / F.sum("k").over(Window.partitionBy())) + 1).cast("int").alias("band"))
    return s.join(F.broadcast(c), "df").groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("df").alias("lo"), F.max("df").alias("hi"), F.round(F.avg("score") + F.stddev_samp("score"), 4).alias("bound"))


@CORE("a12_select_vocabulary")
def a12(spark, d):
    """Terms chosen one by one for value less similarity to those chosen (a greedy top-k report)."""
    from sectloom.operators.selection import select_terms

    return select_terms(post(spark, d), "record_id", k=100, candidates=1000)


@CORE("a15_anomalous_words", sql=r"""WITH t AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM sect_node WHERE text IS NOT NULL), c AS (SELECT lower(w) AS word, count(*) AS n, avg(CASE WHEN w = upper(w) THEN 1.0 ELSE 0.0 END) AS caps FROM t GROUP BY ALL), m AS (SELECT median(length(word)) AS med FROM c), a AS (SELECT median(abs(length(word) - med)) AS mad FROM c, m)
SELECT word, n FROM c, m, a WHERE (caps >= 0.9 AND length(word) > 1) OR length(word) > med + 3 * 1.4826 * mad""")
def a15(spark, d):
    """Words that are nearly always in capitals or far longer than most."""
    t = sections(spark, d).filter("text IS NOT NULL").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), 1)).alias("w"))
    c = cut(t.groupBy(F.lower("w").alias("word")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("w") == F.upper("w"), 1.0).otherwise(0.0)).alias("caps")), "words")
    m = c.agg(F.median(F.length("word")).alias("med"))
    a = c.crossJoin(F.broadcast(m)).agg(F.first("med").alias("med"), F.median(F.abs(F.length("word") - F.col("med"))).alias("mad"))
    return c.crossJoin(F.broadcast(a)).filter("(caps >= 0.9 AND length(word) > 1) OR length(word) > med + 3 * 1.4826 * mad").select("word", "n")


@CORE("a16_signature_pools")
def a16(spark, d):
    """Document frequency pooled over word families: words that share a stem and differ by a productive pair of endings."""
    from sectloom.operators.selection import signature_pools

    return signature_pools(post(spark, d), "record_id", min_pairs=3)


@CORE("a17_probe_recall", sql=POST + f", q AS (SELECT DISTINCT item_id, unnest({tokens('text')}) AS term FROM eval_item), c AS (SELECT unnest([2, 5, 10, 50]) AS cut) SELECT CAST(cut AS INT) AS cut, round(sum(CASE WHEN df >= cut THEN 1 ELSE 0 END) / count(*), 6) AS recall FROM q LEFT JOIN df USING (term), c GROUP BY cut")
def a17(spark, d):
    """Share of query terms that survive a document-frequency cut."""
    q = table(spark, d, "eval_item").select("item_id", F.explode(F.array_distinct(tokenize(F.col("text")))).alias("term"))
    j = q.join(lexical.doc_freq(post(spark, d)), "term", "left").select("df", F.explode(F.array(*[F.lit(c) for c in (2, 5, 10, 50)])).alias("cut"))
    return j.groupBy("cut").agg(F.round(F.sum(F.when(F.col("df") >= F.col("cut"), 1).otherwise(0)) / F.count(F.lit(1)), 6).alias("recall"))


_PAPER = POST + """, pc0 AS (SELECT doc_id, community AS cid, count(*) AS n FROM sect_node WHERE community IS NOT NULL AND community >= 0 GROUP BY ALL), pc AS (SELECT doc_id, cid FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, cid) AS r FROM pc0) WHERE r = 1),
pt AS (SELECT DISTINCT doc_id, term FROM post JOIN sect_node USING (record_id)), cdf AS (SELECT cid, term, count(*) AS df FROM pt JOIN pc USING (doc_id) GROUP BY ALL), size AS (SELECT cid, count(*) AS size FROM pc GROUP BY cid) """


def _papers(spark, d):
    s = sections(spark, d)
    papers = cut(A.paper_communities(s), "papers")
    return papers, cut(A.paper_terms(post(spark, d), s), "terms")


@CORE("a19_paper_index", sql=_PAPER + "SELECT cid, term, df FROM cdf")
def a19(spark, d):
    """Papers of each community that hold each term."""
    papers, terms = _papers(spark, d)
    return A.community_df(terms, papers)


@CORE("a19_modal_community", sql=_PAPER + "SELECT doc_id, cid FROM pc")
def a19b(spark, d):
    """The community of every paper."""
    return A.paper_communities(sections(spark, d))


@CORE("a20_exact_tally", sql=_PAPER + f", q AS (SELECT DISTINCT unnest({tokens('answer')}) AS term FROM eval_item) SELECT term, CAST(coalesce(sum(df), 0) AS BIGINT) AS papers, count(cid) AS communities FROM q LEFT JOIN cdf USING (term) GROUP BY term")
def a20(spark, d):
    """Papers and communities that hold each word of the test answers."""
    papers, terms = _papers(spark, d)
    q = table(spark, d, "eval_item").select(F.explode(tokenize(F.col("answer"))).alias("term")).distinct()
    return q.join(A.community_df(terms, papers), "term", "left").groupBy("term").agg(F.coalesce(F.sum("df"), F.lit(0)).cast("long").alias("papers"), F.count("cid").alias("communities"))


_SIG = _PAPER + """, gl AS (SELECT term, CAST(sum(df) AS BIGINT) AS total FROM cdf GROUP BY term), one AS (SELECT sum(total) AS presence, count(*) AS vocab, (SELECT sum(size) FROM size) AS n FROM gl),
sz AS (SELECT cid, term, df, size, total, n, 10.0 * (total + 0.5) / (presence + 0.5 * (vocab + 1)) AS a1 FROM cdf JOIN gl USING (term) JOIN size USING (cid), one),
zz AS (SELECT cid, term, df, round((ln((df + a1) / (size - df + 10 - a1)) - ln((total - df + a1) / (n - size - total + df + 10 - a1))) / sqrt(1 / (df + a1) + 1 / (size - df + 10 - a1) + 1 / (total - df + a1) + 1 / (n - size - total + df + 10 - a1)), 6) AS z FROM sz),
sg AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY z DESC, term) AS rank FROM zz WHERE z > 0) """


@CORE("c11_signatures", sql=_SIG + "SELECT cid, term, z, df, CAST(rank AS INT) AS rank FROM sg WHERE rank <= 100")
def c11(spark, d):
    """The hundred terms of each community with the largest informative-prior log odds."""
    papers, terms = _papers(spark, d)
    return A.signatures(cut(A.community_df(terms, papers), "df"), papers, 100, 10.0)


_STRATA = _PAPER + """, dr AS (SELECT cid, doc_id, row_number() OVER (PARTITION BY cid ORDER BY md5('s1' || doc_id), doc_id) AS draw FROM pc), lab AS (SELECT doc_id, max(CASE WHEN term = 'cluster' THEN 1 ELSE 0 END) AS yes, max(CASE WHEN term = 'clusters' THEN 1 ELSE 0 END) AS near FROM pt GROUP BY doc_id),
st AS (SELECT cid, any_value(size) AS pop, CAST(sum(CASE WHEN draw <= greatest(2, size // 2) THEN 1 ELSE 0 END) AS BIGINT) AS n, CAST(sum(CASE WHEN draw <= greatest(2, size // 2) AND yes = 1 THEN 1 ELSE 0 END) AS BIGINT) AS yes, CAST(sum(CASE WHEN draw <= greatest(2, size // 2) AND yes = 0 AND near = 1 THEN 1 ELSE 0 END) AS BIGINT) AS unsure FROM dr JOIN size USING (cid) LEFT JOIN lab USING (doc_id) GROUP BY cid) """


def _strata(spark, d):
    """Half of each community's papers drawn; a paper is a yes if it holds 'cluster', unsure if only 'clusters'."""
    papers, terms = _papers(spark, d)
    size = papers.groupBy("cid").agg(F.count(F.lit(1)).alias("pop"))
    drawn = A.draw(papers, size.select("cid", F.greatest(F.lit(2), F.floor(F.col("pop") / 2)).alias("take")), "s1")
    lab = terms.groupBy("doc_id").agg(F.max(F.when(F.col("term") == "cluster", 1).otherwise(0)).alias("y"), F.max(F.when(F.col("term") == "clusters", 1).otherwise(0)).alias("u"))
    j = drawn.join(lab, "doc_id", "left").groupBy("cid").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("yes"), F.sum(F.when((F.col("y") == 0) & (F.col("u") == 1), 1).otherwise(0)).alias("unsure"))
    return cut(size.join(j, "cid"), "strata")


@CORE("a21_stratified", sql=_STRATA + """, v AS (SELECT pop * yes / n AS lo, pop * (yes + unsure) / n AS hi, CAST(pop AS DOUBLE) * pop * ((yes + 0.5) / (n + 1)) * (1 - (yes + 0.5) / (n + 1)) * (CASE WHEN n > 1 THEN n / (n - 1) ELSE 1 END) / n * (1 - n / pop) AS vlo,
CAST(pop AS DOUBLE) * pop * ((yes + unsure + 0.5) / (n + 1)) * (1 - (yes + unsure + 0.5) / (n + 1)) * (CASE WHEN n > 1 THEN n / (n - 1) ELSE 1 END) / n * (1 - n / pop) AS vhi, pop FROM st)
SELECT round((sum(lo) + sum(hi)) / 2, 4) AS estimate, round(greatest(0, sum(lo) - 1.96 * sqrt(sum(vlo))), 4) AS low, round(least(sum(pop), sum(hi) + 1.96 * sqrt(sum(vhi))), 4) AS high FROM v""")
def a21(spark, d):
    """Estimated number of papers that hold a term, from stratified draws, with bounds."""
    return A.stratified(_strata(spark, d))


_LCH = "(lgamma({a} + 1) - lgamma({b} + 1) - lgamma({a} - {b} + 1))"


def _lch(a: str, b: str) -> str:
    return _LCH.format(a=a, b=b)


def _kept(k: str) -> str:
    return f"{_lch('t', k)} + {_lch('(pop - t)', f'(n - {k})')} > ln(0.05 / (2 * (SELECT count(DISTINCT cid) FROM st)) / (n + 1)) + {_lch('pop', 'n')}"


_BOUNDS = "lo AS (SELECT cid, n, min(t) AS low FROM (SELECT *, unnest(range(yes, pop - n + yes + 1)) AS t FROM {st}) WHERE " + _kept("yes") + " GROUP BY cid, n), hi AS (SELECT cid, n, max(t) AS high FROM (SELECT *, unnest(range(yes + unsure, pop - n + yes + unsure + 1)) AS t FROM {st}) WHERE " + _kept("(yes + unsure)") + " GROUP BY cid, n)"


@CORE("a22_ppr_bounds", sql=_STRATA + ", " + _BOUNDS.format(st="st") + " SELECT cid, low, high FROM lo JOIN hi USING (cid, n)")
def a22(spark, d):
    """Hypergeometric confidence bounds of every stratum."""
    return A.sequential(_strata(spark, d), 0.05)


_LOOKS = _STRATA + """, lk AS (SELECT unnest([1, 2, 3]) AS look), sl AS (SELECT cid, look, any_value(pop) AS pop, count(*) AS n, CAST(sum(CASE WHEN yes = 1 THEN 1 ELSE 0 END) AS BIGINT) AS yes, CAST(sum(CASE WHEN yes = 0 AND near = 1 THEN 1 ELSE 0 END) AS BIGINT) AS unsure
FROM (SELECT dr.cid, look, st.pop, coalesce(lab.yes, -1) AS yes, lab.near FROM dr JOIN st USING (cid) LEFT JOIN lab USING (doc_id), lk WHERE draw <= CAST(ceil(st.n * look / 3.0) AS BIGINT)) GROUP BY cid, look) """


def _looks(spark, d):
    """The strata as they stand after a third, two thirds and all of the draws."""
    papers, terms = _papers(spark, d)
    st = _strata(spark, d).select("cid", "pop", F.col("n").alias("all"))
    per = st.withColumn("look", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)]))).withColumn("take", F.ceil(F.col("all") * F.col("look") / 3.0))
    lab = terms.groupBy("doc_id").agg(F.max(F.when(F.col("term") == "cluster", 1).otherwise(0)).alias("y"), F.max(F.when(F.col("term") == "clusters", 1).otherwise(0)).alias("u"))
    w = Window.partitionBy("cid").orderBy(F.md5(F.concat(F.lit("s1"), "doc_id")), "doc_id")
    drawn = papers.withColumn("draw", F.row_number().over(w)).join(per, "cid").filter("draw <= take").join(lab, "doc_id", "left")
    return drawn.groupBy("cid", "look", "pop").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("yes"), F.sum(F.when((F.col("y") == 0) & (F.col("u") == 1), 1).otherwise(0)).alias("unsure"))


@CORE("a23_sequential_total", sql=_LOOKS + ", " + _BOUNDS.format(st="sl") + ", bb AS (SELECT cid, max(low) AS low, min(high) AS high FROM lo JOIN hi USING (cid, n) GROUP BY cid) SELECT CAST(sum(low) AS BIGINT) AS low, CAST(sum(high) AS BIGINT) AS high FROM bb")
def a23(spark, d):
    """Bounds of the total that hold at every look: each stratum's bounds are intersected over three looks."""
    return A.sequential(cut(_looks(spark, d), "looks"), 0.05).agg(F.sum("low").alias("low"), F.sum("high").alias("high"))


@CORE("a24_lexical_routing", sql=_SIG + f", q AS (SELECT DISTINCT item_id, unnest({tokens('text')}) AS term FROM eval_item), h AS (SELECT item_id, cid, round(sum(z), 6) AS score FROM q JOIN sg USING (term) WHERE rank <= 100 GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY item_id ORDER BY score DESC) AS rank FROM h) SELECT item_id, cid, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5")
def a24(spark, d):
    """The five communities each test item is routed to; ties at the end are all kept."""
    papers, terms = _papers(spark, d)
    sig = A.signatures(cut(A.community_df(terms, papers), "df"), papers, 100, 10.0)
    q = table(spark, d, "eval_item").select("item_id", F.explode(F.array_distinct(tokenize(F.col("text")))).alias("term"))
    h = q.join(sig, "term").groupBy("item_id", "cid").agg(F.round(F.sum("z"), 6).alias("score"))
    return h.withColumn("rank", F.rank().over(Window.partitionBy("item_id").orderBy(F.col("score").desc()))).filter("rank <= 5")


@CORE("a25_srswor", sql=_PAPER + "SELECT cid, doc_id, CAST(draw AS INT) AS draw FROM (SELECT cid, doc_id, size, row_number() OVER (PARTITION BY cid ORDER BY md5('s1' || doc_id), doc_id) AS draw FROM pc JOIN size USING (cid)) WHERE draw <= 3")
def a25(spark, d):
    """Three papers drawn from each community without replacement (a sampling operator)."""
    papers = A.paper_communities(sections(spark, d))
    return A.draw(papers, papers.select("cid").distinct().withColumn("take", F.lit(3)), "s1")


_EVEN = """SELECT *, CASE WHEN full_ THEN room ELSE CAST(floor(left_ / k_) AS BIGINT) + CASE WHEN row_number() OVER (ORDER BY full_, cid) <= left_ - floor(left_ / k_) * k_ THEN 1 ELSE 0 END END AS got FROM (SELECT *, amt - sum(CASE WHEN full_ THEN room ELSE 0 END) OVER () AS left_, greatest(1, sum(CASE WHEN full_ THEN 0 ELSE 1 END) OVER ()) AS k_
FROM (SELECT *, below + room * open_ <= amt AS full_ FROM (SELECT *, sum(room) OVER (ORDER BY room, cid) - room AS below, count(*) OVER () - row_number() OVER (ORDER BY room, cid) + 1 AS open_, least(want, sum(room) OVER ()) AS amt FROM ({x}))))"""
_ALLOC = _STRATA + ", w0 AS (SELECT cid, pop AS room, pop * sqrt(((yes + 0.5) / (n + 1)) * (1 - (yes + 0.5) / (n + 1))) AS w FROM st), u AS (SELECT cid, got AS uniform FROM (" + _EVEN.format(x="SELECT cid, room, 100 AS want FROM w0") + ")), b AS (SELECT cid, got AS base FROM (" + _EVEN.format(x="SELECT cid, room, CAST(floor(least(100, sum(room) OVER ()) * 0.2) AS BIGINT) AS want FROM w0") + """)),
c AS (SELECT cid, base, room - base AS cap, w, least(100, sum(room) OVER ()) - sum(base) OVER () AS rest FROM w0 JOIN b USING (cid)), f AS (SELECT *, sum(cap) OVER (ORDER BY cap / w, cid) - cap + cap / w * sum(w) OVER (ORDER BY cap / w, cid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= rest AS full_ FROM c),
g AS (SELECT *, rest - sum(CASE WHEN full_ THEN cap ELSE 0 END) OVER () AS left_, sum(CASE WHEN full_ THEN 0 ELSE w END) OVER () AS open_ FROM f), h AS (SELECT *, CASE WHEN full_ THEN CAST(cap AS DOUBLE) ELSE round(left_ * w / open_, 9) END AS x FROM g), i AS (SELECT *, rest - sum(floor(x)) OVER () AS short, row_number() OVER (ORDER BY x - floor(x) DESC, cid) AS turn FROM h)
SELECT cid, CAST(uniform AS BIGINT) AS uniform, CAST(base + floor(x) + CASE WHEN turn <= short THEN 1 ELSE 0 END AS BIGINT) AS neyman FROM i JOIN u USING (cid)"""


def _spread_of(st):
    """Strata with their Neyman weight: papers times the standard deviation of a yes."""
    p = (F.col("yes") + 0.5) / (F.col("n") + 1)
    return st.withColumn("weight", F.col("pop") * F.sqrt(p * (1 - p)))


@CORE("a26_allocation", sql=_ALLOC)
def a26(spark, d):
    """A draw budget of 100 papers given out evenly and by Neyman weights."""
    st = _spread_of(_strata(spark, d))
    return A.by_weight(A.evenly(st, "pop", 100, "uniform"), "pop", "weight", 100, 0.2, "neyman").select("cid", "uniform", "neyman")


@CORE("a27_semantic_tally")
def a27(spark, d):
    """Estimates of a tally look by look: a pilot of three papers a community, then draws by Neyman weights, until the
    half-width is at most a twentieth of all papers or half of them have been read. Labels already given are kept."""
    papers, terms = _papers(spark, d)
    lab = terms.groupBy("doc_id").agg(F.max(F.when(F.col("term") == "graph", 1).otherwise(0)).alias("y"))
    order = Window.partitionBy("cid").orderBy(F.md5(F.concat(F.lit("s2"), "doc_id")), "doc_id")
    queue = cut(papers.withColumn("draw", F.row_number().over(order)).join(lab, "doc_id", "left").select("cid", "draw", F.coalesce("y", F.lit(0)).alias("y")), "queue")
    size = cut(papers.groupBy("cid").agg(F.count(F.lit(1)).alias("pop")), "size")
    total = papers.count()
    take, out, look = cut(size.select("cid", "pop", F.least(F.lit(3), "pop").cast("long").alias("take")), "take"), None, 0
    while True:
        look += 1
        st = queue.join(take, "cid").filter("draw <= take").groupBy("cid", "pop", "take").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("yes")).withColumn("unsure", F.lit(0))
        st = cut(st, "look")
        e = cut(A.stratified(st).select(F.lit(look).alias("look"), "*"), "estimate")
        out = e if out is None else out.unionByName(e)
        row, used = e.first(), st.agg(F.sum("n")).first()[0]
        if row is None or row.estimate is None or (row.high - row.low) / 2 <= total / 20 or used >= total // 2:
            return out
        more = A.by_weight(_spread_of(st).withColumn("room", F.col("pop") - F.col("take")), "room", "weight", max(1, min(total // 10, total // 2 - used)), 0.2, "more")
        take = cut(more.select("cid", "pop", (F.col("take") + F.col("more")).alias("take")), "take")


@CORE("a29_second_order_terms")
def a29(spark, d):
    """Terms of each community ranked by how well their section weights tell members from others."""
    from sectloom.operators.selection import rank_sum_terms

    s = sections(spark, d).filter("community IS NOT NULL AND community >= 0").select("record_id", F.col("community").alias("cid"))
    gate = _community_table(spark, d).filter("a >= 3 AND a * n > r * c").filter(stats.g2(F.col("a"), F.col("r"), F.col("c"), F.col("n")) >= 10.83).select("cid", "term")
    return rank_sum_terms(lexical.weights(post(spark, d), "record_id").select("record_id", "term", "w"), s, gate)


@CORE("a30_dendrite")
def a30(spark, d):
    """Chains of entities whose section counts correlate, strongest first."""
    from sectloom.operators.selection import correlation_chains

    return correlation_chains(mentions(spark, d), top=60)


@CORE("a31_gold_recall", sql="""WITH g AS (SELECT build_id, doc_id, count(*) AS gold FROM sect_node GROUP BY ALL), f AS (SELECT build_id, doc_id, count(DISTINCT section_idx) AS found FROM lex_chunk_meta WHERE NOT is_junk AND NOT is_reference GROUP BY ALL) SELECT build_id, round(sum(coalesce(found, 0)) / sum(gold), 6) AS recall, round(1 - sum(coalesce(found, 0)) / sum(gold), 6) AS dilution FROM g LEFT JOIN f USING (build_id, doc_id) GROUP BY build_id""")
def a31(spark, d):
    """Share of a build's sections that its retrievable chunks reach."""
    g = sections(spark, d).groupBy("build_id", "doc_id").agg(F.count(F.lit(1)).alias("gold"))
    f = table(spark, d, "lex_chunk_meta").filter("NOT is_junk AND NOT is_reference").groupBy("build_id", "doc_id").agg(F.countDistinct("section_idx").alias("found"))
    r = F.sum(F.coalesce("found", F.lit(0))) / F.sum("gold")
    return g.join(f, ["build_id", "doc_id"], "left").groupBy("build_id").agg(F.round(r, 6).alias("recall"), F.round(1 - r, 6).alias("dilution"))


@CORE("a32_changed_fraction", sql="SELECT label, round(sum(CASE WHEN version > 1 THEN 1 ELSE 0 END) / count(*), 6) AS changed, sum(CASE WHEN version > 1 THEN 1 ELSE 0 END) / count(*) >= 0.05 AS rebuild FROM lex_chunk_meta GROUP BY label")
def a32(spark, d):
    """Share of re-ingested chunks, and whether it calls for a rebuild."""
    c = F.sum(F.when(F.col("version") > 1, 1).otherwise(0)) / F.count(F.lit(1))
    return table(spark, d, "lex_chunk_meta").groupBy("label").agg(F.round(c, 6).alias("changed"), (c >= 0.05).alias("rebuild"))


@CORE("a33_provenance_audit", sql="SELECT build_id, kind, count(*) AS n, round(avg(npmi), 5) AS avg_strength, CAST(sum(n_shared) AS BIGINT) AS shared FROM sect_entity_edge GROUP BY ALL")
def a33(spark, d):
    """Stored edges by kind."""
    return table(spark, d, "sect_entity_edge").groupBy("build_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("npmi").cast("double")), 5).alias("avg_strength"), F.sum("n_shared").alias("shared"))


@CORE("a34_store_counters", sql="SELECT label, build_id, count(*) AS n_rows, CAST(sum(CASE WHEN truncated THEN 1 ELSE 0 END) AS BIGINT) AS truncated, max(nnz) AS max_nnz FROM lex_chunk_meta GROUP BY ALL")
def a34(spark, d):
    """Rows, truncated rows and longest row of each build."""
    return table(spark, d, "lex_chunk_meta").groupBy("label", "build_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("truncated").cast("long")).alias("truncated"), F.max("nnz").alias("max_nnz"))
