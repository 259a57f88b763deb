"""Pieces of SQL that many queries' SQL begins with."""

from __future__ import annotations

from sectloom.functions.text import STOPWORDS

_STOP = "[" + ",".join(f"'{w}'" for w in STOPWORDS) + "]"


def tokens(expr: str) -> str:
    """Index tokens of a text, as a list."""
    return (
        f"list_filter(list_transform(regexp_extract_all(lower({expr}), '[a-z0-9]+'), lambda w: CASE WHEN regexp_full_match(w, '(1[5-9][0-9][0-9]|20[0-9][0-9])') THEN w[1:3] || '0s' ELSE w END), "
        f"lambda w: regexp_full_match(w, '(1[5-9][0-9]|20[0-9])0s') OR (length(w) > 2 AND NOT list_contains({_STOP}, w)))"
    )


#: post(record_id, term, tf), dl, df, nn, wt(record_id, term, tf, df, w) of the sections.
POST = f"""WITH tok AS (SELECT record_id, unnest({tokens('text')}) AS term FROM sect_node WHERE text IS NOT NULL),
post AS (SELECT record_id, term, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT record_id, CAST(sum(tf) AS BIGINT) AS dl FROM post GROUP BY ALL),
df AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY ALL),
nn AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
wt AS (SELECT record_id, term, tf, df, cf, n, dl, ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS w FROM post JOIN df USING (term) JOIN dl USING (record_id), nn)
"""

#: q(item_id, term): distinct terms of every test item.
QUERY = f"q AS (SELECT DISTINCT item_id, unnest({tokens('text')}) AS term FROM eval_item)"

#: m(build_id, ord, entity_id, cnt), mentions that took place, once each; n(build_id, n) their sections; f(build_id, entity_id, df).
MENTIONS = """WITH b AS (SELECT build_id, json_extract_string(params, '$.run_id') AS run_id FROM sect_build),
m AS (SELECT b.build_id, ord, entity_id, CAST(max(cnt) AS BIGINT) AS cnt FROM mentions JOIN b USING (run_id) WHERE cnt > 0 GROUP BY ALL),
n AS (SELECT build_id, count(DISTINCT ord) AS n FROM m GROUP BY ALL),
f AS (SELECT build_id, entity_id, count(*) AS df FROM m GROUP BY ALL)
"""

#: e(build_id, a, b, s): co-mention edges of the section graph, canonical, once each.
EDGES = "e AS (SELECT build_id, least(a, b) AS a, greatest(a, b) AS b, CAST(max(npmi) AS DOUBLE) AS s FROM sect_entity_edge WHERE kind = 'co_mention' AND npmi IS NOT NULL AND npmi > 0 AND a <> b GROUP BY ALL)"
#: y(build_id, a, b, s): the same edges in both directions.
SYM = EDGES + ", y AS (SELECT build_id, a, b, s FROM e UNION ALL SELECT build_id, b, a, s FROM e)"
