"""Entities and relations: pairs, n-grams, aliases, mentions, relation templates."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sectloom.functions import stats
from sectloom.operators.graph import components
from sectloom.plans.runtime import cut, size_bound

MAX_INVENTORY = 1_000_000


def pair_table(m: DataFrame, min_shared: int, max_df: int | None = None) -> DataFrame:
    """(build_id, a, b, ab, na, nb, n): entity pairs a < b in at least ``min_shared`` sections. Entities in fewer
    sections are left out first, which loses none; ``max_df`` leaves out hubs, as the edge definition says."""
    f = m.groupBy("build_id", "entity_id").agg(F.count(F.lit(1)).cast("double").alias("df"))
    n = m.groupBy("build_id", "ord").agg(F.lit(1).alias("o")).groupBy("build_id").agg(F.count(F.lit(1)).cast("double").alias("n"))
    ok = f.filter(F.col("df") >= min_shared)
    if max_df:
        ok = ok.filter(F.col("df") <= max_df)
    x = m.join(ok.select("build_id", "entity_id"), ["build_id", "entity_id"], "left_semi")
    s = x.groupBy("build_id", "ord").agg(F.sort_array(F.collect_list("entity_id")).alias("e")).filter("size(e) > 1")
    p = s.select("build_id", "e", F.posexplode("e").alias("i", "a")).filter("i + 1 < size(e)").select("build_id", "a", F.explode(F.expr("slice(e, i + 2, size(e))")).alias("b"))
    c = p.groupBy("build_id", "a", "b").agg(F.count(F.lit(1)).cast("double").alias("ab")).filter(F.col("ab") >= min_shared)
    c = c.join(f.select("build_id", F.col("entity_id").alias("a"), F.col("df").alias("na")), ["build_id", "a"]).join(f.select("build_id", F.col("entity_id").alias("b"), F.col("df").alias("nb")), ["build_id", "b"])
    return c.join(n, "build_id")


def ngrams(tokens: DataFrame, key: str, max_n: int, min_count: int) -> DataFrame:
    """(n, gram, df, cf): grams of up to ``max_n`` tokens within segments, at least ``min_count`` of each; a gram is
    only counted where both its shorter grams survived, which loses none."""
    w = Window.partitionBy(key, "seg").orderBy("pos")
    t = tokens.select(key, "seg", "pos", "fold")
    out, ok = None, None
    for n in range(1, max_n + 1):
        parts = [F.col("fold")] + [F.lead("fold", i).over(w) for i in range(1, n)]
        g = t.withColumn("gram", F.concat_ws(" ", *parts)).withColumn("_last", parts[-1] if n > 1 else F.col("fold")).withColumn("_l", F.lead("pos", n - 1).over(w) if n > 1 else F.col("pos"))
        g = g.filter((F.col("_l") == F.col("pos") + n - 1))
        if ok is not None:
            head = F.expr("regexp_replace(gram, ' [^ ]+$', '')")
            tail = F.expr("regexp_replace(gram, '^[^ ]+ ', '')")
            g = g.withColumn("h", head).withColumn("t", tail).join(ok.select(F.col("gram").alias("h")), "h", "left_semi").join(ok.select(F.col("gram").alias("t")), "t", "left_semi")
        c = cut(g.groupBy("gram").agg(F.countDistinct(key).alias("df"), F.count(F.lit(1)).alias("cf")).filter(F.col("cf") >= min_count), "grams")
        ok = c
        c = c.select(F.lit(n).alias("n"), "gram", "df", "cf")
        out = c if out is None else out.unionByName(c)
    return out


def gram_features(tokens: DataFrame, grams: DataFrame, key: str) -> DataFrame:
    """(gram, n, cf, npmi, g2, left_entropy, right_entropy, ridf): cohesion at the weakest split and freedom at both ends of grams of two tokens."""
    w = Window.partitionBy(key, "seg").orderBy("pos")
    x = tokens.select("fold", F.lag("fold").over(w).alias("l"), F.lead("fold").over(w).alias("b"), F.lead("fold", 2).over(w).alias("r")).filter("b IS NOT NULL").withColumn("gram", F.concat_ws(" ", "fold", "b"))
    two = grams.filter("n = 2").select("gram", "cf", "df")
    x = cut(x.join(two.select("gram"), "gram", "left_semi"), "contexts")

    def entropy(c):
        k = x.filter(F.col(c).isNotNull()).groupBy("gram", c).agg(F.count(F.lit(1)).alias("k"))
        t = k.groupBy("gram").agg(F.sum("k").alias("t"))
        p = F.col("k") / F.col("t")
        return k.join(t, "gram").groupBy("gram").agg(F.round(-F.sum(p * F.log2(p)), 6).alias("h"))

    uni = grams.filter("n = 1").select("gram", F.col("cf").alias("c1"))
    tot = float(tokens.count())
    docs = float(tokens.select(key).distinct().count())
    j = two.withColumn("a", F.split("gram", " ")[0]).withColumn("b", F.split("gram", " ")[1])
    j = j.join(uni.select(F.col("gram").alias("a"), F.col("c1").alias("ca")), "a").join(uni.select(F.col("gram").alias("b"), F.col("c1").alias("cb")), "b")
    j = j.join(entropy("l").withColumnRenamed("h", "left_entropy"), "gram", "left").join(entropy("r").withColumnRenamed("h", "right_entropy"), "gram", "left").fillna(0.0, ["left_entropy", "right_entropy"])
    return j.select("gram", "cf", "df", F.round(stats.npmi(F.col("cf"), F.col("ca"), F.col("cb"), F.lit(tot)), 6).alias("npmi"), F.round(stats.g2(F.col("cf").cast("double"), F.col("ca").cast("double"), F.col("cb").cast("double"), F.lit(tot)), 4).alias("g2"), "left_entropy", "right_entropy", F.round(stats.residual_idf(F.col("df"), F.col("cf"), F.lit(docs)), 6).alias("ridf"))


_ACRONYM = re.compile(r"((?:[A-Za-z][\w-]*\s+){1,8})\(([A-Z][A-Za-z0-9-]{1,9})\)")


def acronym_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(short, long, n): short forms in brackets after words whose letters spell them, matched from the right."""
    def work(it):
        for pdf in it:
            out = []
            for x in pdf[text]:
                for m in _ACRONYM.finditer(x):
                    words, s = m.group(1), m.group(2)
                    i, j = len(s) - 1, len(words.rstrip()) - 1
                    while i >= 0 and j >= 0:
                        c = s[i].lower()
                        if not c.isalnum():
                            i -= 1
                            continue
                        while j >= 0 and (words[j].lower() != c or (i == 0 and j > 0 and words[j - 1].isalnum())):
                            j -= 1
                        if j < 0:
                            break
                        i, j = i - 1, j - 1
                    if i < 0:
                        out.append((s, words[j + 1 :].strip().lower()))
            yield pd.DataFrame(out, columns=["short", "long"])

    return df.filter(F.length(text) > 0).select(text).mapInPandas(work, "short string, long string").groupBy("short", "long").agg(F.count(F.lit(1)).alias("n"))


def match_inventory(df: DataFrame, key: str, text: str, inventory: DataFrame, surface: str) -> DataFrame:
    """(key, surface, cnt): longest matches of known surfaces, left to right, none overlapping. The inventory is
    broadcast after a check of its size."""
    if not size_bound(inventory, MAX_INVENTORY):
        raise ValueError("the inventory exceeds MAX_INVENTORY")
    rows = [r[0].lower().split() for r in inventory.select(surface).filter(F.col(surface).isNotNull()).distinct().collect()]
    heads: dict[str, list[tuple[str, ...]]] = {}
    for r in rows:
        if r:
            heads.setdefault(r[0], []).append(tuple(r))
    for v in heads.values():
        v.sort(key=lambda t: (-len(t), t))
    shared = df.sparkSession.sparkContext.broadcast(heads)
    kt = df.schema[key].dataType.simpleString()

    def work(it):
        for pdf in it:
            out = []
            for k, x in zip(pdf[key], pdf[text]):
                ws, i, c = re.findall(r"[a-z0-9-]+", x.lower()), 0, {}
                while i < len(ws):
                    for t in shared.value.get(ws[i], ()):
                        if tuple(ws[i : i + len(t)]) == t:
                            c[" ".join(t)] = c.get(" ".join(t), 0) + 1
                            i += len(t)
                            break
                    else:
                        i += 1
                out += [(k, s, n) for s, n in c.items()]
            yield pd.DataFrame(out, columns=[key, "surface", "cnt"])

    return df.filter(F.length(text) > 0).select(key, text).mapInPandas(work, f"{key} {kt}, surface string, cnt int")


def resolve(names: DataFrame, name: str, ratio: float = 0.9) -> DataFrame:
    """(name, canonical): names whose spellings agree to ``ratio`` and share trigrams are one; the longest, then
    least, spelling stands for all. Only pairs that share a rare trigram and fit in length are compared."""
    n = names.select(F.lower(F.trim(F.regexp_replace(name, r"\s+", " "))).alias("id")).filter("length(id) >= 4").distinct()
    g = n.select("id", F.explode(F.array_distinct(F.expr("transform(sequence(1, length(id) - 2), i -> substring(id, i, 3))"))).alias("g"))
    df = g.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    w = Window.partitionBy("id").orderBy("df", "g")
    # a pair at this ratio shares one of its rarest trigrams: all but the share that edits can destroy
    keep = F.ceil((1 - ratio) * 3 * F.length("id") + 1)
    key = g.join(df, "g").withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= keep).select("id", "g")
    p = key.select("g", F.col("id").alias("a")).join(key.select("g", F.col("id").alias("b")), "g").filter("a < b").filter(2.0 * F.least(F.length("a"), F.length("b")) >= ratio * (F.length("a") + F.length("b"))).select("a", "b").distinct()

    @F.pandas_udf("double")
    def like(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, x, y, False).ratio() for x, y in zip(a, b)], dtype=float)

    e = cut(p.withColumn("r", like("a", "b")).filter(F.col("r") >= ratio).select("a", "b"), "same")
    c = components(e, n)
    best = Window.partitionBy("component").orderBy(F.length("id").desc(), "id")
    return c.withColumn("canonical", F.first("id").over(best)).select(F.col("id").alias("name"), "canonical")


def relation_candidates(sentences: DataFrame, key: str, max_gap: int = 5) -> DataFrame:
    """(template, a, b, n): pairs of invented-looking or capitalised words in a sentence with up to ``max_gap`` words between, by the words between."""
    def work(it):
        for pdf in it:
            out = []
            for x in pdf["sentence"]:
                ws = re.findall(r"'s|[A-Za-z0-9]+", re.sub(r"['’]s\b", " 's", x))
                at = [i for i, w in enumerate(ws) if w[:1].isupper() and i > 0 and w.isalpha()]
                for i, j in zip(at, at[1:]):
                    if 1 <= j - i - 1 <= max_gap:
                        mid = ["GEN" if w == "'s" else w.lower() for w in ws[i + 1 : j]]
                        out.append((" ".join(mid), ws[i].lower(), ws[j].lower()))
            yield pd.DataFrame(out, columns=["template", "a", "b"])

    return sentences.select("sentence").mapInPandas(work, "template string, a string, b string").groupBy("template", "a", "b").agg(F.count(F.lit(1)).alias("n"))
