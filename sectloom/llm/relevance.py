"""How distinctive a term is per record: probabilistic relevance weights."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.5, 0.75


def idf(n_docs: Column, df: Column) -> Column:
    """ln(1 + (N - df + 0.5) / (df + 0.5)): never negative."""
    return F.log(F.lit(1.0) + (n_docs - df + 0.5) / (df + 0.5))


def clean_term(col: str) -> Column:
    """Lower case, without white space at either end."""
    return F.lower(F.regexp_replace(F.col(col), r"(?U)^\s+|\s+$", ""))


def term_relevance(tf: DataFrame, scope: str, record: str, term: str, weight: str, *, k1: float = K1, b: float = B) -> DataFrame:
    """Score of every (scope, record, term): saturating term frequency, document-length
    normalisation against the scope's average length, and collection document frequency.

    ``tf`` may hold several rows of one term; their weights are added. Rows with a null key or a
    weight that is null or not above 0 are ignored; an empty table gives no rows. Every statistic
    is summed over all rows; a hot scope or record is pre-aggregated before each shuffle. Returned
    beside score: tf, record_len, n_records (of the scope), df (records of the scope with the term),
    term_total and scope_total, from which exact shares follow.
    """
    t = (
        tf.filter(F.col(scope).isNotNull() & F.col(record).isNotNull() & F.col(term).isNotNull() & (F.col(weight) > 0))
        .groupBy(F.col(scope).alias("_s"), F.col(record).alias("_r"), F.col(term).alias("_t")).agg(F.sum(F.col(weight).cast("long")).alias("tf"))
    )
    lens = t.groupBy("_s", "_r").agg(F.sum("tf").alias("record_len"))
    scopes = lens.groupBy("_s").agg(F.count(F.lit(1)).alias("n_records"), F.sum("record_len").alias("scope_total"))
    terms = t.groupBy("_s", "_t").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("term_total"))
    j = t.join(lens, ["_s", "_r"]).join(terms, ["_s", "_t"]).join(scopes, "_s")
    avg = F.col("scope_total") / F.col("n_records")
    sat = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("record_len") / avg))
    return j.select(
        F.col("_s").alias(scope), F.col("_r").alias(record), F.col("_t").alias(term), "tf", "record_len", "n_records", "df", "term_total", "scope_total",
        (idf(F.col("n_records"), F.col("df")) * sat).alias("score"),
    )


def community_terms(global_df: DataFrame) -> DataFrame:
    """Rows of global_qa_term_df ready for scoring: rows alike in all columns count once, spellings
    that differ in case or outer blanks become one term."""
    return global_df.select("qa_build_id", "community_id", "term", "df").distinct().withColumn("term", clean_term("term"))


WORD = re.compile(r"[^\W_]+|[^\w\s]|_")


def pieces_of(word: str, vocab: set[str]) -> list[str]:
    """Greedy longest pieces of a word; a word that no pieces spell gives none."""
    out, i, n = [], 0, len(word)
    while i < n:
        for j in range(n, i, -1):
            p = word[i:j] if i == 0 else "##" + word[i:j]
            if p in vocab:
                out.append(p)
                i = j
                break
        else:
            return []
    return out


#: The vocabulary is frozen when a tokenizer is made and does not grow with the data; above this many rows per label it is refused.
MAX_VOCAB = 2_000_000


def piece_counts(chunks: DataFrame, vocab: DataFrame) -> DataFrame:
    """(label, record_id, piece, tf) of each chunk under the vocabulary of its label.

    The vocabulary is broadcast after its size is checked against MAX_VOCAB. Null and empty texts,
    and labels without a vocabulary, give no rows.
    """
    spark = chunks.sparkSession
    rows = vocab.filter(F.col("piece").isNotNull() & F.col("label").isNotNull()).select("label", "piece").distinct().limit(MAX_VOCAB + 1).collect()
    if len(rows) > MAX_VOCAB:
        raise ValueError("the vocabulary exceeds MAX_VOCAB")
    by: dict[str, set[str]] = {}
    for r in rows:
        by.setdefault(r.label, set()).add(r.piece)
    shared = spark.sparkContext.broadcast(by)

    def count(it):
        memo: dict[tuple[str, str], list[str]] = {}
        for pdf in it:
            out = []
            for label, rid, text in zip(pdf.label, pdf.record_id, pdf.text):
                v = shared.value.get(label)
                if not v or not text:
                    continue
                c: Counter = Counter()
                for w, n in Counter(WORD.findall(text.lower())).items():
                    ps = memo.get((label, w))
                    if ps is None:
                        if len(memo) > 500_000:
                            memo.clear()
                        ps = memo[label, w] = pieces_of(w, v) if len(w) <= 200 else []
                    for p in ps:
                        c[p] += n
                out += [(label, rid, p, n) for p, n in c.items()]
            yield pd.DataFrame(out, columns=["label", "record_id", "piece", "tf"])

    return chunks.select("label", "record_id", "text").filter(F.col("record_id").isNotNull()).mapInPandas(count, "label string, record_id long, piece string, tf long")


def fill_idf(vocab: DataFrame, counts: DataFrame) -> DataFrame:
    """(label, col, piece, idf, filled): stored idf where it is above 0, else computed from the
    collection: documents of the label that hold the piece. A piece in no document gets df 0."""
    docs = counts.groupBy("label", "record_id").agg(F.lit(1).alias("_o")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    dfs = counts.groupBy("label", "piece").agg(F.count(F.lit(1)).alias("df"))
    v = vocab.select("label", "col", "piece", F.col("idf").cast("double").alias("stored"))
    j = v.join(dfs, ["label", "piece"], "left").join(docs, "label", "left").fillna(0, ["df", "n"])
    have = F.col("stored").isNotNull() & ~F.isnan("stored") & (F.col("stored") > 0)
    return j.select("label", "col", "piece", F.round(F.when(have, F.col("stored")).otherwise(idf(F.col("n"), F.col("df"))), 6).alias("idf"), (~have).alias("filled"))
