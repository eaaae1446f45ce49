"""The model's tables in DuckDB SQL, for checking queries against another engine."""

from __future__ import annotations

import re

#: Each table over the source tables and the ones before it.
TABLES: dict[str, str] = {
    "communities":
    "SELECT s_suppkey AS id, s_name AS name, greatest(CAST(trunc(s_acctbal) AS INTEGER), 0) AS subscribers, s_nationkey AS nation FROM "
    "supplier",
    "users": "SELECT c_custkey AS id, c_name AS username FROM customer",
    "lines": "SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, "
    "l_quantity) AS n FROM lineitem",
    "all_posts": "SELECT o_orderkey AS id, o_custkey AS author_id, l_suppkey AS community_id, o_orderpriority || ' ' || o_orderstatus AS title, "
    "CAST(trunc(o_totalprice / 1000) AS INTEGER) AS score, o_orderdate AS created_at FROM orders LEFT JOIN (SELECT l_orderkey, "
    "l_suppkey FROM lines WHERE n = 1) ON o_orderkey = l_orderkey",
    "posts": "SELECT * FROM all_posts WHERE community_id IS NOT NULL",
    "comments": "SELECT l_orderkey || '_' || n AS id, l_orderkey AS post_id, o_custkey AS author_id, l_suppkey AS community_id, CASE WHEN n = 1 "
    "THEN 't3_' || l_orderkey ELSE 't1_' || l_orderkey || '_' || (n - 1) END AS parent_id, 'flag ' || l_returnflag || ' status ' || "
    "l_linestatus AS body, CAST(trunc(l_quantity) AS INTEGER) AS score, CAST(n - 1 AS INTEGER) AS depth, l_shipdate AS created_at FROM "
    "lines JOIN orders ON o_orderkey = l_orderkey",
    "cross_references":
    "SELECT * FROM (SELECT l_orderkey AS post_id, l_suppkey AS source, lead(l_suppkey) OVER w AS target, lead(l_shipdate) OVER w AS "
    "observed_at FROM lines WINDOW w AS (PARTITION BY l_orderkey ORDER BY n)) WHERE target IS NOT NULL AND source <> target",
    "points": "SELECT 'point_' || vec_id AS id, 'P' || vec_id AS name, CAST(vec_id * 7 % 1000 AS VARCHAR) AS val, ['community', 'user', 'post', "
    "'comment'][vec_id % 4 + 1] AS type, label AS community_id, CAST(embedding[1] AS DOUBLE) AS pos_x, CAST(embedding[2] AS DOUBLE) AS "
    "pos_y, CAST(embedding[3] AS DOUBLE) AS pos_z FROM embeddings",
    "active": "SELECT author_id AS user_id, community_id, count(*) AS activity_count FROM (SELECT author_id, community_id FROM posts UNION ALL "
    "SELECT author_id, community_id FROM comments) GROUP BY ALL",
    "pairs": "SELECT a.community_id AS u, b.community_id AS v, count(*) AS overlap_count FROM active a JOIN active b ON a.user_id = b.user_id "
    "AND a.community_id < b.community_id GROUP BY ALL",
    "relationships": "SELECT u AS source, v AS target, overlap_count FROM pairs WHERE overlap_count >= 2 UNION ALL SELECT v, u, overlap_count FROM "
    "pairs WHERE overlap_count >= 2",
    "nodes": "SELECT 'community_' || id AS id, name, CAST(subscribers AS VARCHAR) AS val, 'community' AS type FROM communities UNION ALL SELECT "
    "'user_' || id, username, CAST(coalesce(t, 0) AS VARCHAR), 'user' FROM users LEFT JOIN (SELECT user_id, CAST(sum(activity_count) "
    "AS BIGINT) AS t FROM active GROUP BY 1) ON id = user_id UNION ALL SELECT 'post_' || id, title, CAST(score AS VARCHAR), 'post' "
    "FROM posts",
    "weighted": "SELECT *, CASE WHEN regexp_full_match(val, '[0-9]+') THEN CAST(val AS BIGINT) ELSE 0 END AS w FROM nodes",
    "links": "SELECT 'user_' || user_id AS source, 'community_' || community_id AS target FROM active UNION ALL SELECT 'community_' || source, "
    "'community_' || target FROM relationships UNION ALL SELECT 'post_' || id, 'community_' || community_id FROM posts",
    "degree": "SELECT id, count(*) AS degree FROM (SELECT source AS id FROM links UNION ALL SELECT target FROM links) GROUP BY 1",
    "cand": "SELECT least(source, target) AS u, greatest(source, target) AS v FROM relationships UNION SELECT least(source, target), "
    "greatest(source, target) FROM cross_references",
    "marg": "SELECT c.id, coalesce(a.a, 0) AS m_active, coalesce(p.p, 0) AS m_authors, coalesce(a.r, 0) AS m_repeat, coalesce(x.x, 0) AS "
    "m_cross FROM (SELECT community_id AS id FROM active UNION SELECT source FROM cross_references UNION SELECT target FROM "
    "cross_references) c LEFT JOIN (SELECT community_id AS id, count(*) AS a, sum(least(activity_count, 100)) AS r FROM active GROUP "
    "BY 1) a USING (id) LEFT JOIN (SELECT community_id AS id, count(DISTINCT author_id) AS p FROM posts GROUP BY 1) p USING (id) LEFT "
    "JOIN (SELECT id, count(*) AS x FROM (SELECT source AS id FROM cross_references UNION ALL SELECT target FROM cross_references) "
    "GROUP BY 1) x USING (id)",
    "univ": "SELECT (SELECT count(DISTINCT user_id) FROM active) AS t_active, (SELECT count(DISTINCT author_id) FROM posts) AS t_authors, "
    "(SELECT sum(least(activity_count, 100)) FROM active) AS t_repeat, (SELECT 2 * count(*) FROM cross_references) AS t_cross",
    "evid": "SELECT u, v, coalesce(o_active, 0) AS o_active, coalesce(o_authors, 0) AS o_authors, coalesce(o_repeat, 0) AS o_repeat, "
    "coalesce(o_cross, 0) AS o_cross FROM cand LEFT JOIN (SELECT a.community_id AS u, b.community_id AS v, count(*) AS o_active, "
    "least(sum(least(a.activity_count, b.activity_count)), 100) AS o_repeat FROM active a JOIN active b ON a.user_id = b.user_id AND "
    "a.community_id < b.community_id GROUP BY ALL) USING (u, v) LEFT JOIN (SELECT a.community_id AS u, b.community_id AS v, count(*) "
    "AS o_authors FROM (SELECT DISTINCT author_id, community_id FROM posts) a JOIN (SELECT DISTINCT author_id, community_id FROM "
    "posts) b ON a.author_id = b.author_id AND a.community_id < b.community_id GROUP BY ALL) USING (u, v) LEFT JOIN (SELECT "
    "least(source, target) AS u, greatest(source, target) AS v, count(*) AS o_cross FROM cross_references GROUP BY ALL) USING (u, v)",
}


def _layer(k: str) -> str:
    o, a, b, t = (f"CAST({x} AS DOUBLE)" for x in (f"o_{k}", f"l.m_{k}", f"r.m_{k}", f"t_{k}"))
    ok = f"({t} > 0 AND {o} >= 0 AND {o} <= {a} AND {o} <= {b} AND {a} <= {t} AND {b} <= {t})"
    npmi = f"CASE WHEN {o} >= {t} THEN 1.0 ELSE greatest(least(ln(({o} / {t}) / (({a} / {t}) * ({b} / {t}))) / -ln({o} / {t}), 1.0), 0.0) END"
    return f"{ok} AS ok_{k}, CASE WHEN {ok} AND {o} > 0 THEN ({npmi}) * ln(1 + {o}) * ({o} / ({o} + 5.0)) ELSE 0.0 END AS raw_{k}"


_W = {"active": 0.6, "authors": 0.2, "repeat": 0.1, "cross": 0.1}
TABLES["raw"] = f"SELECT u, v, {', '.join(map(_layer, _W))} FROM evid JOIN marg l ON l.id = u JOIN marg r ON r.id = v CROSS JOIN univ"
TABLES["aff"] = (
    "SELECT u, v, raw_active, raw_authors, raw_repeat, raw_cross, m / (1 + m) AS affinity FROM (SELECT *, CASE WHEN w > 0 THEN t / w "
    "ELSE 0.0 END AS m FROM (SELECT *, " + " + ".join(f"CASE WHEN ok_{k} THEN {w} ELSE 0.0 END" for k, w in _W.items()) + " AS w, " + " + ".join(
    f"CASE WHEN ok_{k} THEN {w} ELSE 0.0 END * raw_{k}" for k, w in _W.items()) + " AS t FROM raw))")
#: Communities in groups by nation, and nations in macro groups, for what works on groups.
TABLES["groups"] = "SELECT id, nation AS group_id FROM communities"
TABLES["landmarks"] = (
    "SELECT community_id AS id, community_id % 3 AS macro_id, count(*) AS size, round(sum(pos_x * pos_x), 6) AS distinctiveness, "
    "least(count(*) / 20.0, 1.0) AS confidence, community_id % 2 = 0 AS is_bridge FROM points GROUP BY 1")
TABLES["docs"] = (
    "SELECT d.doc_id AS id, regexp_extract(text, '^[^\\n]*') AS title, text AS body, lang, source, coalesce(toxic, 0) = 1 AS sensitive "
    "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
TABLES["ents"] = (
    "SELECT 'community_' || id AS id, name AS label, 'community' AS type, CAST(subscribers AS BIGINT) AS value, NULL AS parent_id, "
    "NULL AS author_id, 'community_' || id AS community_id FROM communities"
    " UNION ALL SELECT 'user_' || id, username, 'user', CAST(coalesce(t, 0) AS BIGINT), NULL, NULL, 'community_' || home FROM users "
    "LEFT JOIN (SELECT user_id, sum(activity_count) AS t, first(community_id ORDER BY activity_count DESC, community_id) AS home FROM "
    "active GROUP BY 1) ON id = user_id"
    " UNION ALL SELECT 'post_' || id, title, 'post', CAST(score AS BIGINT), 'community_' || community_id, 'user_' || author_id, "
    "'community_' || community_id FROM posts"
    " UNION ALL SELECT 'comment_' || id, body, 'comment', CAST(score AS BIGINT), CASE WHEN parent_id LIKE 't1_%' THEN 'comment_' ELSE "
    "'post_' END || substr(parent_id, 4), 'user_' || author_id, 'community_' || community_id FROM comments"
)
TABLES["structural"] = (
    "SELECT source, target, relation FROM (SELECT author_id AS source, id AS target, 'authorship' AS relation FROM ents WHERE "
    "author_id IS NOT NULL UNION ALL SELECT id, parent_id, CASE WHEN type = 'post' THEN 'published_in' WHEN parent_id LIKE 'comment%' "
    "THEN 'reply' ELSE 'comment_on' END FROM ents WHERE parent_id IS NOT NULL) WHERE source IN (SELECT id FROM ents) AND target IN "
    "(SELECT id FROM ents)")


def with_tables(sql: str) -> str:
    """The SQL with those of the model's tables in front that it needs."""
    needed: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in TABLES:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text, re.I):
                needed.add(name)
                todo.append(TABLES[name])
    parts = [f"{n} AS ({t})" for n, t in TABLES.items() if n in needed]
    return f"WITH {', '.join(parts)} {sql}" if parts else sql
