"""Sources, builds, increments, joins and windows: S01-S18, I01-I08, J01-J13, W01-W07, X-rows and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sectloom.functions import stats
from sectloom.functions import text as X
from sectloom.functions.vec import dot, norm
from sectloom.operators import lexical
from sectloom.operators import lifecycle as Y
from sectloom.operators.lexical import top
from sectloom.plans.base import edges, mentions, post, sections, symmetric
from sectloom.plans.registry import CORE
from sectloom.plans.runtime import cut, table
from sectloom.plans.sqlparts import EDGES, MENTIONS, POST, SYM
from sectloom.sources.corpora import mixed
from sectloom.streaming import ingest as I

_NEW = "v AS (SELECT *, row_number() OVER (PARTITION BY build_id, doc_id, section_idx, chunk_idx ORDER BY version DESC, record_id DESC) AS r FROM lex_chunk_meta)"
_KEYS = ["build_id", "doc_id", "section_idx", "chunk_idx"]


def _chunks(spark, d):
    return table(spark, d, "lex_chunk_meta")


@CORE("s01_latest_versions", sql="WITH st AS (SELECT doc_id AS paper_id, max(version) AS stored FROM lex_chunk_meta GROUP BY doc_id), p AS (SELECT paper_id, version, doc_id, row_number() OVER (PARTITION BY paper_id ORDER BY version DESC, doc_id) AS r FROM documents WHERE paper_id IS NOT NULL AND trim(text, ' ') <> '') SELECT p.paper_id, version, p.doc_id FROM p LEFT JOIN st USING (paper_id) WHERE r = 1 AND (stored IS NULL OR version > stored)")
def s01(spark, d):
    """Papers to load: the newest version with text of each, unless one as new is stored."""
    p = table(spark, d, "documents").filter("paper_id IS NOT NULL AND trim(text) <> ''").select("paper_id", "version", "doc_id")
    w = Window.partitionBy("paper_id").orderBy(F.col("version").desc(), "doc_id")
    st = _chunks(spark, d).groupBy(F.col("doc_id").alias("paper_id")).agg(F.max("version").alias("stored"))
    return p.withColumn("_r", F.row_number().over(w)).filter("_r = 1").join(st, "paper_id", "left").filter("stored IS NULL OR version > stored").select("paper_id", "version", "doc_id")


@CORE("s04_mixed_corpus", sql="SELECT part, source, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM (SELECT 0 AS part, 'documents' AS source, text FROM documents UNION ALL SELECT 1, 'sections', text FROM sect_node UNION ALL SELECT 2, 'items', text FROM eval_item) WHERE length(trim(text, ' ')) > 0 GROUP BY ALL")
def s04(spark, d):
    """Three corpora in a fixed order, blanks dropped."""
    m = mixed([("documents", table(spark, d, "documents"), "doc_id", "text", 1), ("sections", sections(spark, d), "record_id", "text", 1), ("items", table(spark, d, "eval_item"), "item_id", "text", 1)])
    return m.groupBy("part", "source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@CORE("s06_length_band", sql="WITH x AS (SELECT item_id, log2(length(text)) AS x FROM eval_item), m AS (SELECT median(x) AS m FROM x), a AS (SELECT median(abs(x - m)) AS mad FROM x, m) SELECT item_id FROM x, m, a WHERE abs(x - m) <= 2 * 1.4826 * mad")
def s06(spark, d):
    """Items whose log length lies within two robust deviations."""
    x = table(spark, d, "eval_item").select("item_id", F.log2(F.length("text")).alias("x"))
    m = x.agg(F.median("x").alias("m"))
    a = x.crossJoin(F.broadcast(m)).agg(F.first("m").alias("m"), F.median(F.abs(F.col("x") - F.col("m"))).alias("mad"))  # one-row tables
    return x.crossJoin(F.broadcast(a)).filter(F.abs(F.col("x") - F.col("m")) <= 2 * 1.4826 * F.col("mad")).select("item_id")


@CORE("s11_publish_checks", sql="SELECT build_id, claimed, counted, claimed IS NOT NULL AND claimed = counted AS ok FROM (SELECT b.build_id, b.n_nodes AS claimed, count(n.record_id) AS counted FROM sect_build b LEFT JOIN sect_node n USING (build_id) GROUP BY ALL)")
def s11(spark, d):
    """Claimed and counted nodes of every build."""
    n = sections(spark, d).groupBy("build_id").agg(F.count(F.lit(1)).alias("counted"))
    b = table(spark, d, "sect_build").join(n, "build_id", "left").fillna(0, ["counted"])
    return b.select("build_id", F.col("n_nodes").alias("claimed"), "counted", F.coalesce(F.col("n_nodes") == F.col("counted"), F.lit(False)).alias("ok"))


@CORE("s12_truncated_rows", sql=POST + ", r AS (SELECT record_id, term, row_number() OVER (PARTITION BY record_id ORDER BY round(w, 6) DESC, term) AS r FROM wt) SELECT record_id, CAST(sum(CASE WHEN r <= 50 THEN 1 ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN r > 50 THEN 1 ELSE 0 END) AS BIGINT) AS dropped FROM r GROUP BY record_id")
def s12(spark, d):
    """Entries of each row kept and dropped by a cap of fifty (the writer's truncation, with its count)."""
    from sectloom.operators.lexical import weights

    w = weights(post(spark, d), "record_id")
    r = w.withColumn("r", F.row_number().over(Window.partitionBy("record_id").orderBy(F.round("w", 6).desc(), "term")))
    return r.groupBy("record_id").agg(F.sum((F.col("r") <= 50).cast("long")).alias("kept"), F.sum((F.col("r") > 50).cast("long")).alias("dropped"))


@CORE("s13_append_ords", sql="WITH b AS (SELECT build_id, max(ord) AS top FROM sect_node GROUP BY build_id), c AS (SELECT build_id, record_id, row_number() OVER (PARTITION BY build_id ORDER BY record_id) AS k FROM lex_chunk_meta WHERE version > 1) SELECT build_id, record_id, CAST(top + k AS INT) AS ord FROM c JOIN b USING (build_id)")
def s13(spark, d):
    """Ords of appended rows, going on from the build's last."""
    b = sections(spark, d).groupBy("build_id").agg(F.max("ord").alias("top"))
    c = _chunks(spark, d).filter("version > 1").withColumn("k", F.row_number().over(Window.partitionBy("build_id").orderBy("record_id")))
    return c.join(b, "build_id").select("build_id", "record_id", (F.col("top") + F.col("k")).cast("int").alias("ord"))


@CORE("s14_replace_papers", sql="WITH g AS (SELECT DISTINCT doc_id FROM lex_chunk_meta WHERE version > 1) SELECT record_id FROM lex_chunk_meta WHERE version > 1 OR doc_id NOT IN (SELECT doc_id FROM g)")
def s14(spark, d):
    """Chunks once papers that came again are replaced by their new rows."""
    c = _chunks(spark, d)
    g = c.filter("version > 1").select("doc_id").distinct()
    return c.filter("version <= 1").join(g, "doc_id", "left_anti").select("record_id").unionByName(c.filter("version > 1").select("record_id"))


@CORE("s15_id_clashes", sql=r"SELECT regexp_replace(paper_id, 'v\d+$', '') AS paper, count(DISTINCT paper_id) AS spellings FROM documents WHERE paper_id IS NOT NULL GROUP BY ALL")
def s15(spark, d):
    """Spellings that fall onto one paper id."""
    return table(spark, d, "documents").filter("paper_id IS NOT NULL").groupBy(X.paper_id(F.col("paper_id")).alias("paper")).agg(F.countDistinct("paper_id").alias("spellings"))


@CORE("s16_export_contains", sql=POST + "SELECT record_id, term, tf FROM post WHERE tf >= 2")
def s16(spark, d):
    """Section-term rows of the graph export: terms used at least twice."""
    return post(spark, d).filter("tf >= 2")


_ENDS = "(SELECT build_id, a AS id FROM sect_entity_edge UNION ALL SELECT build_id, b FROM sect_entity_edge)"


@CORE("s16_export_checks", sql=POST + f""", b AS (SELECT build_id, json_extract_string(params, '$.run_id') AS run_id FROM sect_build), ent AS (SELECT DISTINCT build_id, entity_id AS id FROM mentions JOIN b USING (run_id))
SELECT 'contains' AS part, count(*) AS n FROM post WHERE tf >= 2 UNION ALL SELECT 'terms', count(DISTINCT term) FROM post WHERE tf >= 2 UNION ALL SELECT 'similar', count(*) FROM sect_entity_edge WHERE kind = 'co_mention' UNION ALL SELECT 'dangling_ends', count(*) FROM {_ENDS} x WHERE NOT EXISTS (SELECT 1 FROM ent WHERE ent.build_id = x.build_id AND ent.id = x.id)
UNION ALL SELECT 'ragged_vectors', count(*) FROM sect_embedding WHERE emb IS NOT NULL AND len(emb) <> 256""")
def s16b(spark, d):
    """Rows of each part of the export, ends of edges that no mention knows, and vectors of another length."""
    p = post(spark, d).filter("tf >= 2")
    e = table(spark, d, "sect_entity_edge")
    b = table(spark, d, "sect_build").select("build_id", F.get_json_object("params", "$.run_id").alias("run_id"))
    known = table(spark, d, "mentions").join(b, "run_id").select("build_id", F.col("entity_id").alias("id")).distinct()
    ends = e.select("build_id", F.explode(F.array("a", "b")).alias("id")).join(known, ["build_id", "id"], "left_anti")
    parts = {"contains": p, "terms": p.select("term").distinct(), "similar": e.filter("kind = 'co_mention'"), "dangling_ends": ends, "ragged_vectors": table(spark, d, "sect_embedding").filter("emb IS NOT NULL AND size(emb) <> 256")}
    out = None
    for name, df in parts.items():
        n = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@CORE("s18_mirror_counts", sql="WITH " + EDGES + " SELECT b.build_id, (SELECT count(*) FROM sect_node n WHERE n.build_id = b.build_id) AS vertices, (SELECT count(*) FROM e WHERE e.build_id = b.build_id) AS edges FROM sect_build b")
def s18(spark, d):
    """Vertices and edges of each build, as a mirror is verified."""
    n = sections(spark, d).groupBy("build_id").agg(F.count(F.lit(1)).alias("vertices"))
    e = edges(spark, d).groupBy("build_id").agg(F.count(F.lit(1)).alias("edges"))
    return table(spark, d, "sect_build").select("build_id").join(n, "build_id", "left").join(e, "build_id", "left").fillna(0)


@CORE("i02_frozen_ingest", sql=POST + ", f AS (SELECT record_id, term, tf FROM post JOIN sect_node USING (record_id) WHERE build_id = 1), fl AS (SELECT record_id, sum(tf) AS dl FROM f GROUP BY record_id), fn AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM fl), fd AS (SELECT term, count(*) AS df FROM f GROUP BY term), x AS (SELECT record_id, term, tf, dl.dl FROM post JOIN dl USING (record_id) JOIN sect_node USING (record_id) WHERE build_id <> 1) SELECT record_id, count(*) AS terms, count(df) AS known, round(coalesce(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))), 0), 4) AS mass FROM x LEFT JOIN fd USING (term), fn GROUP BY record_id")
def i02(spark, d):
    """Later sections under the first build's frozen statistics: its document frequencies, number and mean length weigh their
    terms, and a term it does not know weighs nothing."""
    p = cut(post(spark, d).join(sections(spark, d).select("record_id", "build_id"), "record_id"), "post")
    f = p.filter("build_id = 1").drop("build_id")
    one = lexical.corpus_size(f, "record_id")
    x = p.filter("build_id <> 1").drop("build_id")
    j = x.join(lexical.doc_lengths(x, "record_id"), "record_id").join(lexical.doc_freq(f).select("term", "df"), "term", "left").crossJoin(F.broadcast(one))  # one row
    w = stats.bm25(F.col("tf"), F.col("df"), F.col("dl"), F.col("n"), F.col("avgdl"))
    return j.groupBy("record_id").agg(F.count(F.lit(1)).alias("terms"), F.count("df").alias("known"), F.round(F.coalesce(F.sum(w), F.lit(0.0)), 4).alias("mass"))


@CORE("i03_version_upsert", sql=f"WITH {_NEW} SELECT record_id, version FROM v WHERE r = 1")
def i03(spark, d):
    """Chunks once all versions are applied: the highest of each wins."""
    c = _chunks(spark, d)
    return Y.upsert(Y.newest(c.filter("version = 1"), _KEYS, "version", "record_id"), c.filter("version > 1"), _KEYS, "version", "record_id").select("record_id", "version")


@CORE("i04_exact_dedup", sql="SELECT min(record_id) AS record_id, count(*) AS copies FROM lex_chunk_meta WHERE text IS NOT NULL GROUP BY md5(text)")
def i04(spark, d):
    """First chunk of each exact text and the number of its copies."""
    return _chunks(spark, d).filter("text IS NOT NULL").groupBy(F.md5("text").alias("h")).agg(F.min("record_id").alias("record_id"), F.count(F.lit(1)).alias("copies")).drop("h")


@CORE("i05_partial_papers", sql="SELECT doc_id, count(*) AS rows_, CAST(sum(CASE WHEN ingested_at IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS open FROM lex_chunk_meta GROUP BY doc_id HAVING sum(CASE WHEN ingested_at IS NULL THEN 1 ELSE 0 END) > 0")
def i05(spark, d):
    """Papers with chunks that have no time of ingestion."""
    return _chunks(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows_"), F.sum(F.col("ingested_at").isNull().cast("long")).alias("open")).filter("open > 0")


@CORE("i06_rebuild_gate", sql="SELECT build_id, round(avg(CASE WHEN version > 1 THEN 1.0 ELSE 0.0 END), 6) AS changed, avg(CASE WHEN version > 1 THEN 1.0 ELSE 0.0 END) >= 0.05 AS rebuild FROM lex_chunk_meta GROUP BY build_id")
def i06(spark, d):
    """Share of changed chunks of each build against the rebuild threshold."""
    c = F.avg(F.when(F.col("version") > 1, 1.0).otherwise(0.0))
    return _chunks(spark, d).groupBy("build_id").agg(F.round(c, 6).alias("changed"), (c >= 0.05).alias("rebuild"))


@CORE("i07_companion_state", sql="WITH c AS (SELECT build_id, count(DISTINCT doc_id || ':' || section_idx) AS n FROM lex_chunk_meta GROUP BY build_id), s AS (SELECT build_id, count(*) AS m FROM sect_node GROUP BY build_id) SELECT build_id, n, m, n <> m AS stale FROM c JOIN s USING (build_id)")
def i07(spark, d):
    """Sections in the chunk index against the section map."""
    c = _chunks(spark, d).groupBy("build_id").agg(F.countDistinct("doc_id", "section_idx").alias("n"))
    s = sections(spark, d).groupBy("build_id").agg(F.count(F.lit(1)).alias("m"))
    return c.join(s, "build_id").select("build_id", "n", "m", (F.col("n") != F.col("m")).alias("stale"))


_IV = "iv AS (SELECT event_id, user_id, event_type, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS valid_to FROM events)"


def _intervals(spark, d):
    return Y.intervals(table(spark, d, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], "ts")


@CORE("i08_supersede", sql="WITH " + EDGES + ", r AS (SELECT build_id, tag, created_at AS valid_from, lead(created_at) OVER (ORDER BY created_at, build_id) AS valid_to FROM sect_build), n AS (SELECT build_id, count(*) AS n FROM e GROUP BY build_id) SELECT r.build_id, valid_from, valid_to, valid_to IS NULL AS live, coalesce(n, 0) AS edges, CASE WHEN valid_to IS NULL THEN 0 ELSE coalesce(n, 0) END AS closed FROM r LEFT JOIN n USING (build_id)")
def i08(spark, d):
    """Builds as runs of one label: each is retired when the next is made, which closes its open edges; the last is live."""
    r = table(spark, d, "sect_build").select("build_id", "created_at").withColumn("valid_to", F.lead("created_at").over(Window.orderBy("created_at", "build_id")))  # a row a build
    n = edges(spark, d).groupBy("build_id").agg(F.count(F.lit(1)).alias("edges"))
    j = r.join(n, "build_id", "left").fillna(0, ["edges"])
    return j.select("build_id", F.col("created_at").alias("valid_from"), "valid_to", F.col("valid_to").isNull().alias("live"), "edges", F.when(F.col("valid_to").isNull(), 0).otherwise(F.col("edges")).alias("closed"))


@CORE("j12_as_of", sql=f"WITH {_IV} SELECT user_id, event_type, event_id FROM iv WHERE valid_from <= TIMESTAMP '2024-01-15 00:00:00' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-15 00:00:00')")
def j12(spark, d):
    """States that were valid at an instant."""
    return Y.as_of(_intervals(spark, d), F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).select("user_id", "event_type", "event_id")


@CORE("j01_inner_join", sql="SELECT n_name, count(*) AS orders, CAST(sum(o_totalprice) AS DECIMAL(38, 2)) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name".replace("CAST(sum(o_totalprice) AS DECIMAL(38, 2))", "round(sum(CAST(o_totalprice AS DOUBLE)), 0)"))
def j01(spark, d):
    """Orders by nation."""
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).groupBy("n_name").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum(F.col("o_totalprice").cast("double")), 0).alias("total"))


@CORE("j02_left_join", sql="SELECT n.build_id, count(*) AS n, count(e.record_id) AS with_vector FROM sect_node n LEFT JOIN (SELECT DISTINCT record_id FROM sect_embedding) e USING (record_id) GROUP BY n.build_id")
def j02(spark, d):
    """Sections with and without a vector row."""
    e = table(spark, d, "sect_embedding").select("record_id").distinct().withColumn("h", F.lit(1))
    return sections(spark, d).join(e, "record_id", "left").groupBy("build_id").agg(F.count(F.lit(1)).alias("n"), F.count("h").alias("with_vector"))


@CORE("j03_semi_join", sql="SELECT record_id FROM sect_node n WHERE EXISTS (SELECT 1 FROM lex_chunk_meta c WHERE c.build_id = n.build_id AND c.doc_id = n.doc_id AND c.section_idx = n.section_idx AND c.version > 1)")
def j03(spark, d):
    """Sections with a chunk that came again."""
    return sections(spark, d).join(_chunks(spark, d).filter("version > 1"), ["build_id", "doc_id", "section_idx"], "left_semi").select("record_id")


@CORE("j04_anti_join", sql="SELECT record_id FROM sect_node n WHERE NOT EXISTS (SELECT 1 FROM sect_embedding e WHERE e.record_id = n.record_id)")
def j04(spark, d):
    """Sections without a vector row."""
    return sections(spark, d).join(table(spark, d, "sect_embedding"), "record_id", "left_anti").select("record_id")


@CORE("j05_theta_pairs", sql=MENTIONS + "SELECT x.build_id, x.ord, count(*) AS pairs FROM m x JOIN m z ON z.build_id = x.build_id AND z.ord = x.ord AND z.entity_id > x.entity_id GROUP BY ALL")
def j05(spark, d):
    """Pairs of entities of each section, the lesser first: a join by inequality within a section, which names few."""
    m = mentions(spark, d).select("build_id", "ord", "entity_id")
    y = m.withColumnRenamed("entity_id", "e2")
    on = "x.build_id = y.build_id AND x.ord = y.ord AND y.e2 > x.entity_id"
    return m.alias("x").join(y.alias("y"), F.expr(on)).groupBy("x.build_id", "x.ord").agg(F.count(F.lit(1)).alias("pairs"))


@CORE("j06_array_containment", sql=MENTIONS + ", c AS (SELECT build_id, community AS cid, list(ord) AS members FROM sect_node WHERE community >= 0 GROUP BY ALL) SELECT m.build_id, cid, count(*) AS mentions FROM m JOIN c ON c.build_id = m.build_id AND list_contains(members, m.ord) GROUP BY ALL")
def j06(spark, d):
    """Mentions of each community's member list: lists are opened to memberships once, and joined on equality."""
    c = sections(spark, d).filter("community >= 0").groupBy("build_id", F.col("community").alias("cid"), F.pmod("ord", F.lit(64))).agg(F.collect_list("ord").alias("members"))
    m = c.select("build_id", "cid", F.explode("members").alias("ord"))
    return mentions(spark, d).join(m, ["build_id", "ord"]).groupBy("build_id", "cid").agg(F.count(F.lit(1)).alias("mentions"))


@CORE("j07_inline_table", sql="SELECT name, count(*) AS n FROM events JOIN (VALUES (1, 'one'), (2, 'two'), (3, 'three')) AS v(user_id, name) USING (user_id) GROUP BY name")
def j07(spark, d):
    """Events of users named in an inline table."""
    v = spark.sql("SELECT * FROM VALUES (1L, 'one'), (2L, 'two'), (3L, 'three') AS v(user_id, name)")
    return table(spark, d, "events").join(F.broadcast(v), "user_id").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@CORE("j10_natural_key", sql="SELECT build_id, count(*) AS n, count(DISTINCT section_idx) AS places FROM sect_node JOIN (SELECT DISTINCT build_id, doc_id, section_idx FROM lex_chunk_meta) USING (build_id, doc_id, section_idx) GROUP BY build_id")
def j10(spark, d):
    """Sections and chunks joined on the columns they share by name."""
    k = _chunks(spark, d).select("build_id", "doc_id", "section_idx").distinct()
    return sections(spark, d).join(k, ["build_id", "doc_id", "section_idx"]).groupBy("build_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("section_idx").alias("places"))


@CORE("j11_recursive_reach", sql="WITH RECURSIVE " + SYM + ", w AS (SELECT build_id, min(a) AS node, 0 AS hop FROM y GROUP BY build_id UNION SELECT y.build_id, y.b, hop + 1 FROM w JOIN y ON y.build_id = w.build_id AND y.a = w.node WHERE hop < 3) SELECT build_id, node, min(hop) AS hop FROM w GROUP BY ALL")
def j11(spark, d):
    """Nodes within three hops of each build's first node, by a recursive join that never returns to one it has met."""
    y = cut(symmetric(edges(spark, d)).select("build_id", "a", "b"), "sym")
    front = y.groupBy("build_id").agg(F.min("a").alias("node"))
    seen = front.withColumn("hop", F.lit(0))
    for hop in (1, 2, 3):
        nxt = front.withColumnRenamed("node", "a").join(y, ["build_id", "a"]).select("build_id", F.col("b").alias("node")).distinct()
        front = cut(nxt.join(seen, ["build_id", "node"], "left_anti"), "front")
        seen = seen.unionByName(front.withColumn("hop", F.lit(hop)))
    return seen


@CORE("j13_scalar_subquery", sql="SELECT event_type, count(*) AS n FROM events WHERE value > (SELECT avg(value) FROM events) GROUP BY event_type")
def j13(spark, d):
    """Events above the mean value of all."""
    return spark.sql("SELECT event_type, count(*) AS n FROM {e} WHERE value > (SELECT avg(value) FROM {e}) GROUP BY event_type", e=table(spark, d, "events"))


@CORE("w03_top_k", sql="SELECT event_id, user_id, value FROM events ORDER BY value DESC NULLS LAST, event_id LIMIT 50")
def w03(spark, d):
    """The fifty largest events in a total order (a top-k report)."""
    return table(spark, d, "events").select("event_id", "user_id", "value").orderBy(F.col("value").desc_nulls_last(), "event_id").limit(50)


@CORE("j08_map_unnest", sql="SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS n FROM events GROUP BY k")
def j08(spark, d):
    """Events by a key of their properties."""
    m = table(spark, d, "events").select(F.explode(F.from_json("props", "map<string,int>")).alias("name", "k")).filter("name = 'k'")
    return m.groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@CORE("j09_scalar_cross", sql="SELECT event_type, round(count(*) / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY event_type")
def j09(spark, d):
    """Share of each kind of event."""
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(e.agg(F.count(F.lit(1)).alias("t")))).select("event_type", F.round(F.col("n") / F.col("t"), 6).alias("share"))  # one row


@CORE("w01_row_number", sql="SELECT user_id, event_id, CAST(r AS INT) AS r FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 3")
def w01(spark, d):
    """The three largest events of each user."""
    return top(table(spark, d, "events").select("user_id", "event_id", "value"), ["user_id"], [F.col("value").desc(), F.col("event_id")], 3, "r").select("user_id", "event_id", "r")


@CORE("w02_distinct_on", sql="SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def w02(spark, d):
    """The last event of each user."""
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@CORE("w04_adjacent_rows", sql="SELECT user_id, round(avg(epoch(ts) - epoch(p)), 2) AS gap FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NOT NULL GROUP BY user_id")
def w04(spark, d):
    """Mean gap between a user's events, in seconds."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    secs = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    e = table(spark, d, "events").withColumn("p", F.lag("ts").over(w)).filter("p IS NOT NULL")
    return e.groupBy("user_id").agg(F.round(F.avg(secs("ts") - secs("p")), 2).alias("gap"))


@CORE("w05_set_operations", sql="SELECT kind, count(*) AS n FROM (SELECT 'both' AS kind, t FROM (SELECT lower(term) AS t FROM global_qa_term_df INTERSECT SELECT lower(piece) FROM lex_vocab) UNION ALL SELECT 'terms', t FROM (SELECT lower(term) AS t FROM global_qa_term_df EXCEPT SELECT lower(piece) FROM lex_vocab)) GROUP BY kind")
def w05(spark, d):
    """Terms that are vocabulary pieces, and those that are not."""
    a = table(spark, d, "global_qa_term_df").select(F.lower("term").alias("t"))
    b = table(spark, d, "lex_vocab").select(F.lower("piece").alias("t"))
    return a.intersect(b).withColumn("kind", F.lit("both")).unionByName(a.subtract(b).withColumn("kind", F.lit("terms"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@CORE("w06_derived_columns", sql="SELECT record_id, md5(text) AS digest, text_md5 IS NULL OR text_md5 <> md5(text) AS differs FROM lex_chunk_meta")
def w06(spark, d):
    """Digest of each chunk, and whether the stored one is missing or differs."""
    return _chunks(spark, d).select("record_id", F.md5("text").alias("digest"), (F.col("text_md5").isNull() | (F.col("text_md5") != F.md5("text"))).alias("differs"))


@CORE("w07_symmetric_view", sql="WITH " + SYM + " SELECT build_id, count(*) AS n, count(DISTINCT a) AS nodes FROM y GROUP BY build_id")
def w07(spark, d):
    """Rows and nodes of the symmetric edge view."""
    return symmetric(edges(spark, d)).groupBy("build_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("a").alias("nodes"))


@CORE("x05_stored_versions", sql="SELECT doc_id, max(version) AS version FROM lex_chunk_meta GROUP BY doc_id")
def x05(spark, d):
    """Highest stored version of every paper."""
    return _chunks(spark, d).groupBy("doc_id").agg(F.max("version").alias("version"))


@CORE("x07_retrievable", sql="SELECT build_id, count(*) AS n, CAST(sum(CASE WHEN is_junk THEN 1 ELSE 0 END) AS BIGINT) AS junk, CAST(sum(CASE WHEN NOT is_junk AND NOT is_reference THEN 1 ELSE 0 END) AS BIGINT) AS retrievable FROM lex_chunk_meta GROUP BY build_id")
def x07(spark, d):
    """Chunks of each build: all, junk, retrievable."""
    return _chunks(spark, d).groupBy("build_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_junk").cast("long")).alias("junk"), F.sum((~F.col("is_junk") & ~F.col("is_reference")).cast("long")).alias("retrievable"))


@CORE("x10_fingerprints", sql=f"WITH {_NEW} SELECT build_id, doc_id, sha256(string_agg(text, chr(10) ORDER BY section_idx, chunk_idx)) AS print FROM v WHERE r = 1 GROUP BY ALL")
def x10(spark, d):
    """Content fingerprint of every paper: its newest chunks in order."""
    v = Y.newest(_chunks(spark, d), _KEYS, "version", "record_id")
    t = F.transform(F.array_sort(F.collect_list(F.struct("section_idx", "chunk_idx", "text"))), lambda s: s["text"])
    return v.groupBy("build_id", "doc_id").agg(F.sha2(F.array_join(t, "\n"), 256).alias("print"))


@CORE("x15_unit_vectors", sql="WITH v AS (SELECT record_id, min(list_transform(emb, lambda x: CAST(x AS DOUBLE))) AS v FROM sect_embedding JOIN sect_node USING (record_id) WHERE community = 0 AND len(emb) = 256 AND len(list_filter(emb, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(emb, lambda x: x <> 0)) > 0 GROUP BY record_id) SELECT record_id, round(v[1] / sqrt(list_inner_product(v, v)), 6) AS first, round(v[256] / sqrt(list_inner_product(v, v)), 6) AS last FROM v")
def x15(spark, d):
    """Vectors of a set of nodes (the sections of community 0) at unit length: their first and last number."""
    from sectloom.plans.q_search import _unit_vectors

    v = _unit_vectors(spark, d).join(sections(spark, d).filter("community = 0").select("record_id"), "record_id", "left_semi")
    return v.select("record_id", F.round(F.col("v")[0], 6).alias("first"), F.round(F.col("v")[255], 6).alias("last"))


@CORE("x22_paper_texts", sql=f"WITH {_NEW}, t AS (SELECT build_id, doc_id, substr(string_agg(text, chr(10) || chr(10) ORDER BY section_idx, chunk_idx), 1, 20000) AS t, sum(length(text)) + 2 * (count(*) - 1) AS chars FROM v WHERE r = 1 AND text IS NOT NULL GROUP BY ALL) SELECT build_id, doc_id, CAST(chars AS BIGINT) AS chars, chars > 20000 AS truncated, md5(t) AS digest FROM t")
def x22(spark, d):
    """The first 20,000 characters of every paper's newest chunks in order (the reading budget), its whole length, and whether it
    was cut. Only chunks that begin within the budget are gathered."""
    v = Y.newest(_chunks(spark, d), _KEYS, "version", "record_id").filter("text IS NOT NULL")
    w = Window.partitionBy("build_id", "doc_id").orderBy("section_idx", "chunk_idx")
    x = v.select("build_id", "doc_id", "section_idx", "chunk_idx", "text", (F.sum(F.length("text") + 2).over(w) - F.length("text") - 2).alias("at"))
    size = x.groupBy("build_id", "doc_id").agg(F.max(F.col("at") + F.length("text")).alias("chars"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("section_idx", "chunk_idx", "text"))), lambda s: s["text"])
    t = x.filter("at < 20000").groupBy("build_id", "doc_id").agg(F.substring(F.array_join(parts, "\n\n"), 1, 20000).alias("t"))
    return size.join(t, ["build_id", "doc_id"]).select("build_id", "doc_id", "chars", (F.col("chars") > 20000).alias("truncated"), F.md5("t").alias("digest"))


@CORE("x25_gold_sentences")
def x25(spark, d):
    """Sentences of eight to thirty words, the first of each section by hash order: a gold set of body sentences."""
    from sectloom.operators.segment import sentences

    s = sentences(sections(spark, d), "record_id", "text").filter("n_words BETWEEN 8 AND 30")
    w = Window.partitionBy("record_id").orderBy(F.md5(F.concat_ws(":", "record_id", "sent")))
    return s.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


@CORE("x28_sample_allocation", sql="WITH c AS (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source), t AS (SELECT sum(n) AS t FROM c), q AS (SELECT source, 200.0 * n / t AS q FROM c, t), f AS (SELECT source, floor(q) AS f, row_number() OVER (ORDER BY round(q - floor(q), 9) DESC, source) AS r, 200 - sum(floor(q)) OVER () AS l FROM q) SELECT source, CAST(f + CASE WHEN r <= l THEN 1 ELSE 0 END AS BIGINT) AS take FROM f")
def x28(spark, d):
    """200 draws shared out over sources in proportion, fractions by largest remainder."""
    c = table(spark, d, "documents").filter("source IS NOT NULL").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    q = c.crossJoin(F.broadcast(c.agg(F.sum("n").alias("t")))).select("source", (200.0 * F.col("n") / F.col("t")).alias("q")).withColumn("f", F.floor("q"))
    w = Window.orderBy(F.round(F.col("q") - F.col("f"), 9).desc(), "source")  # one row a source
    q = q.withColumn("r", F.row_number().over(w)).crossJoin(F.broadcast(q.agg((200 - F.sum("f")).alias("l"))))
    return q.select("source", (F.col("f") + (F.col("r") <= F.col("l")).cast("long")).alias("take"))


@CORE("x34_source_counts", sql="WITH s AS (SELECT build_id, community AS cid, doc_id FROM sect_node WHERE community >= 0) SELECT build_id, cid, count(*) AS n, count(DISTINCT doc_id) AS papers FROM s GROUP BY ALL")
def x34(spark, d):
    """Sections and papers of each community."""
    return sections(spark, d).filter("community >= 0").groupBy("build_id", F.col("community").alias("cid")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("papers"))


@CORE("stream_windows", sql="SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def stream_windows(spark, d):
    """Events by hour and kind; the same expression serves streams with a watermark."""
    w = I.windowed_counts(table(spark, d, "events"), "ts", "event_type", "1 hour")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@CORE("stream_sessions", sql="WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS x FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT user_id, sum(x) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY ALL) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY user_id")
def stream_sessions(spark, d):
    """Sessions of each user with gaps under six hours."""
    return I.sessions(table(spark, d, "events"), "ts", "user_id", "6 hours").groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))
