"""p6: terms and pieces that are characteristic of a record."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sectloom.llm.base import LLM
from sectloom.llm.relevance import community_terms, fill_idf, piece_counts, term_relevance
from sectloom.plans.runtime import cut, table

_T = r"""
WITH r AS (SELECT DISTINCT qa_build_id, community_id, term, df FROM global_qa_term_df),
t AS (SELECT qa_build_id, community_id, lower(regexp_replace(term, '^\s+|\s+$', '', 'g')) AS term, CAST(sum(df) AS BIGINT) AS tf FROM r WHERE df > 0 AND term IS NOT NULL AND community_id IS NOT NULL AND qa_build_id IS NOT NULL GROUP BY ALL),
l AS (SELECT qa_build_id, community_id, sum(tf) AS dl FROM t GROUP BY ALL),
s AS (SELECT qa_build_id, count(*) AS n, sum(dl) AS total FROM l GROUP BY ALL),
w AS (SELECT qa_build_id, term, count(*) AS dfc, sum(tf) AS tt FROM t GROUP BY ALL)
"""


def _scored(spark, d):
    return term_relevance(community_terms(table(spark, d, "global_qa_term_df")), "qa_build_id", "community_id", "term", "df")


@LLM("p6_found", sql=_T + "SELECT t.qa_build_id, t.community_id, t.term FROM t JOIN l USING (qa_build_id, community_id) JOIN s USING (qa_build_id) JOIN w USING (qa_build_id, term) WHERE tf >= 5 AND tf * total >= 5 * dl * tt")
def p6_found(spark, d):
    """Terms with df of at least 5 whose share in the community is at least 5 times the build's:
    terms with a positive relevance score, checked exactly in whole numbers."""
    s = _scored(spark, d).filter(F.col("score") > 0)
    keep = (F.col("tf") >= 5) & (F.col("tf") * F.col("scope_total") >= 5 * F.col("record_len") * F.col("term_total"))
    return s.filter(keep).select("qa_build_id", "community_id", "term")


@LLM("p6_term_scores", sql=_T + """SELECT t.qa_build_id, t.community_id, t.term, t.tf, CAST(dfc AS BIGINT) AS df,
round(ln(1 + (n - dfc + 0.5) / (dfc + 0.5)) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (total / n)))), 6) AS score
FROM t JOIN l USING (qa_build_id, community_id) JOIN s USING (qa_build_id) JOIN w USING (qa_build_id, term)""")
def p6_term_scores(spark, d):
    """Relevance of every term of every community."""
    return _scored(spark, d).select("qa_build_id", "community_id", "term", "tf", "df", F.round("score", 6).alias("score"))


@LLM("p6_chunk_pieces")
def p6_chunk_pieces(spark, d):
    """The ten most characteristic vocabulary pieces of every chunk (a top-k report)."""
    c = piece_counts(table(spark, d, "lex_chunk_meta"), table(spark, d, "lex_vocab"))
    s = term_relevance(cut(c, "pieces"), "label", "record_id", "piece", "tf")
    w = Window.partitionBy("label", "record_id").orderBy(F.col("score").desc(), "piece")
    return s.withColumn("rank", F.row_number().over(w)).filter("rank <= 10").select("label", "record_id", "piece", "tf", "df", F.round("score", 6).alias("score"), "rank")


@LLM("p6_idf_filled")
def p6_idf_filled(spark, d):
    """lex_vocab with missing idf computed from the chunks."""
    v = table(spark, d, "lex_vocab")
    return fill_idf(v, cut(piece_counts(table(spark, d, "lex_chunk_meta"), v), "pieces"))
