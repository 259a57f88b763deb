"""Search composed of lists: anchors from several sources, routing by source, quotas, hops and packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sectloom.operators.lexical import top

# fixed values: share of the weakest anchor's score that an extra must reach; temperature and least weight of the router; rank constant of the fusion
COMPETITIVE, TEMPERATURE, LEAST_WEIGHT, RRF = 0.5, 0.2, 0.05, 60


def anchors(hits: DataFrame, query: str, key: str, k: int, most: int) -> DataFrame:
    """(query, key, source, score, extra): the k best hits of each query, and of every source that none of them comes from
    its best hit, if that reaches COMPETITIVE of the weakest of the k; best extras first, ``most`` rows in all.

    ``hits`` has (query, key, source, score). Rows without a source can be among the k, never extras. Queries
    without hits give no rows. Extras are added: they displace none of the k.
    """
    order = [F.col("score").desc(), F.col(key)]
    base = top(hits, [query], order, k)
    low = base.groupBy(query).agg(F.min("score").alias("_low"), F.count(F.lit(1)).alias("_n"))
    best = top(hits.filter("source IS NOT NULL"), [query, "source"], order, 1)
    extra = best.join(base.select(query, "source").distinct(), [query, "source"], "left_anti").join(low, query).filter(F.col("score") >= COMPETITIVE * F.col("_low"))
    w = Window.partitionBy(query).orderBy(*order)
    extra = extra.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most - F.col("_n"))
    return base.select(query, key, "source", "score", F.lit(False).alias("extra")).unionByName(extra.select(query, key, "source", "score", F.lit(True).alias("extra")))


def router(terms: DataFrame, post: DataFrame, query: str, source: str = "source", tau: float = TEMPERATURE) -> DataFrame:
    """(query, source, weight): which source a query speaks like: a softmax of the mean log ratio of its terms' chances in the
    source and in all sources, counted in occurrences. ``post`` has (source, term, tf), source null where unknown.
    Terms that occur nowhere count nothing; queries without any other give no rows."""
    occ = post.groupBy(source, "term").agg(F.sum("tf").cast("double").alias("occ"))
    known = occ.filter(F.col(source).isNotNull())
    size = known.groupBy(source).agg(F.sum("occ").alias("size"))  # a row a source
    total = size.agg(F.sum("size").alias("total"))
    everywhere = occ.groupBy("term").agg(F.sum(F.when(F.col(source).isNotNull(), F.col("occ")).otherwise(0.0)).alias("all"))
    q = terms.select(query, "term").distinct().join(everywhere, "term")
    grid = q.crossJoin(F.broadcast(size)).crossJoin(F.broadcast(total)).join(known, [source, "term"], "left")  # a row a source, and one row
    share = (F.coalesce("occ", F.lit(0.0)) + 0.5) / (F.col("size") + 0.5)
    base = F.greatest(F.when(F.col("all") > 0, F.col("all")).otherwise(1.0) / F.col("total"), F.lit(1e-12))
    lo = grid.groupBy(query, source).agg(F.avg(F.log(share / base)).alias("lo"))
    w = Window.partitionBy(query)
    e = lo.withColumn("e", F.exp((F.col("lo") - F.max("lo").over(w)) / tau))
    return e.select(query, source, (F.col("e") / F.sum("e").over(w)).alias("weight"))


def quotas(weights: DataFrame, query: str, budget: int) -> DataFrame:
    """(query, source, mix, quota): a budget split by the router's weights, none below LEAST_WEIGHT, in thousandths, by largest
    remainder; ties go to the larger mix, then the lesser source."""
    w = Window.partitionBy(query)
    x = weights.withColumn("w", F.greatest("weight", F.lit(LEAST_WEIGHT))).withColumn("mix", F.greatest(F.round(F.round(1000 * F.col("w") / F.sum("w").over(w), 9)).cast("long"), F.lit(1)))
    x = x.withColumn("exact", budget * F.col("mix") / F.sum("mix").over(w)).withColumn("whole", F.floor("exact"))
    turn = F.row_number().over(w.orderBy(F.round(F.col("exact") - F.col("whole"), 9).desc(), F.col("mix").desc(), "source"))
    x = x.withColumn("turn", turn).withColumn("short", budget - F.sum("whole").over(w))
    return x.select(query, "source", "mix", (F.col("whole") + (F.col("turn") <= F.col("short")).cast("int")).cast("long").alias("quota"))


def ring(cands: DataFrame, quota: DataFrame, query: str, key: str, budget: int) -> DataFrame:
    """(query, key, source, score): each source's best candidates up to its quota, and what is left of the budget by score
    over all, candidates without a source or quota included."""
    order = [F.col("score").desc(), F.col(key)]
    x = cands.join(quota.select(query, "source", "quota"), [query, "source"], "left")
    own = F.row_number().over(Window.partitionBy(query, "source").orderBy(*order))
    x = x.withColumn("due", F.coalesce(F.when(F.col("source").isNotNull(), own) <= F.col("quota"), F.lit(False)))
    w = Window.partitionBy(query).orderBy(F.col("due").desc(), *order)
    return x.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= budget).select(query, key, "source", "score")


def rank_fusion(lists: list[DataFrame], query: str, key: str) -> DataFrame:
    """(query, key, rrf): reciprocal rank fusion of lists (query, key, rank)."""
    u = lists[0].select(query, key, "rank")
    for x in lists[1:]:
        u = u.unionByName(x.select(query, key, "rank"))
    return u.groupBy(query, key).agg(F.round(F.sum(1.0 / (RRF + F.col("rank"))), 8).alias("rrf"))


def term_affinity(terms: DataFrame, community: DataFrame, query: str) -> DataFrame:
    """(query, cid, affinity): mean over a query's terms of a community's score over the term's largest, of the terms that
    any community has. ``community`` has (cid, term, g2), g2 above 0."""
    most = community.groupBy("term").agg(F.max("g2").alias("most"))
    q = terms.select(query, "term").distinct().join(most, "term")
    n = q.groupBy(query).agg(F.count(F.lit(1)).alias("n"))
    return q.join(community, "term").groupBy(query, "cid").agg(F.sum(F.col("g2") / F.col("most")).alias("s")).join(n, query).select(query, "cid", (F.col("s") / F.col("n")).alias("affinity"))


def hop_pool(sym: DataFrame, seeds: DataFrame, by: list[str], hops: int, per: int, most: int) -> DataFrame:
    """(by, node, hop, weight): nodes within ``hops`` of the seeds that are no seeds, hop by hop. Each node of the front lists its
    ``per`` strongest neighbours not yet met; lists are fused by rank, the ``most`` best are kept, and only they
    spread further. ``sym`` has (by, a, b, s), ``seeds`` (by, node)."""
    seen = front = seeds.select(*by, "node").distinct()
    out = None
    for hop in range(1, hops + 1):
        near = sym.join(front.withColumnRenamed("node", "a"), [*by, "a"]).join(seen.withColumnRenamed("node", "b"), [*by, "b"], "left_anti")
        lists = top(near, [*by, "a"], [F.col("s").desc(), F.col("b")], per)
        got = lists.groupBy(*by, F.col("b").alias("node")).agg(F.round(F.sum(1.0 / (RRF + F.col("rank"))), 8).alias("rrf"), F.max("s").alias("weight"))
        kept = top(got, by, [F.col("rrf").desc(), F.col("node")], most).select(*by, "node", F.lit(hop).alias("hop"), "weight")
        out = kept if out is None else out.unionByName(kept)
        front = kept.select(*by, "node")
        seen = seen.unionByName(front)
    return out


def entity_hops(mentions: DataFrame, sections: DataFrame, seeds: DataFrame, hops: int, most: int, max_df: int) -> DataFrame:
    """(build_id, ord, hop, score, shared): sections first reached from the seed sections over entities of at most ``max_df``
    sections, ``most`` a hop, best by the sum of ln(N / df); only what a hop added spreads further."""
    df = mentions.groupBy("build_id", "entity_id").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") <= max_df)
    n = sections.groupBy("build_id").agg(F.count(F.lit(1)).alias("n"))
    m = mentions.join(df, ["build_id", "entity_id"]).join(n, "build_id").select("build_id", "ord", "entity_id", F.log(F.col("n") / F.col("df")).alias("w"))
    seen = front = seeds.select("build_id", "ord").distinct()
    out = None
    for hop in range(1, hops + 1):
        ents = m.join(front, ["build_id", "ord"], "left_semi").select("build_id", "entity_id").distinct()
        got = m.join(ents, ["build_id", "entity_id"], "left_semi").join(seen, ["build_id", "ord"], "left_anti").groupBy("build_id", "ord").agg(F.round(F.sum("w"), 6).alias("score"), F.count(F.lit(1)).alias("shared"))
        kept = top(got, ["build_id"], [F.col("score").desc(), F.col("ord")], most).select("build_id", "ord", F.lit(hop).alias("hop"), "score", "shared")
        out = kept if out is None else out.unionByName(kept)
        front = kept.select("build_id", "ord")
        seen = seen.unionByName(front)
    return out


def pack_whole(units: DataFrame, query: str, key: str, size: Column, budget: int) -> DataFrame:
    """(query, key, rank, used): whole units in rank order until the budget is spent; one that does not fit is skipped and smaller
    ones are tried, the first is always kept. Lists are bounded by the rank that the caller kept."""
    one = F.struct(F.col("rank").cast("int").alias("rank"), F.col(key).alias("key"), size.cast("long").alias("size"))
    l = units.groupBy(query).agg(F.array_sort(F.collect_list(one)).alias("l"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.filter(F.transform("l", lambda x: F.struct(x["rank"].alias("rank"), x["key"].alias("key"), x["size"].alias("used"))), lambda x: F.lit(False)).alias("kept"))

    def step(acc, x):
        fits = (F.size(acc["kept"]) == 0) | (acc["used"] + x["size"] <= budget)
        used = acc["used"] + x["size"]
        return F.when(fits, F.struct(used.alias("used"), F.concat(acc["kept"], F.array(F.struct(x["rank"].alias("rank"), x["key"].alias("key"), used.alias("used")))).alias("kept"))).otherwise(acc)

    kept = l.select(query, F.explode(F.aggregate("l", start, step)["kept"]).alias("z"))
    return kept.select(query, F.col("z.key").alias(key), F.col("z.rank").alias("rank"), F.col("z.used").alias("used"))
