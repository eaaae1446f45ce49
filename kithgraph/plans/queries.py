"""Every operator as a query on the driver's tables, beside SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithgraph.functions import columns as C
from kithgraph.operators import affinity, client, communities, integrity, layout, ranking, relational, scopes, search, spatial
from kithgraph.plans import catalog, publish
from kithgraph.plans.registry import ORACLE_SQL, QUERIES, add
from kithgraph.sources import exports
from kithgraph.sources.corpus import Corpus
from kithgraph.streaming import incremental

__all__ = ["ORACLE_SQL", "QUERIES"]

_TOP = "ORDER BY w DESC, id LIMIT"
_BOX = (-0.5, 0.5, -0.4, 0.6, -0.5, 0.4)
_IN_BOX = "pos_x BETWEEN -0.5 AND 0.5 AND pos_y BETWEEN -0.4 AND 0.6 AND pos_z BETWEEN -0.5 AND 0.4"
_PW = "CAST(val AS BIGINT)"


def _r(c: str, digits: int = 6) -> F.Column:
    return F.round(c, digits).alias(c)


# --- scans, lookups, projections
add("scan_communities", lambda c: c.communities, "SELECT * FROM communities")
add("scan_users", lambda c: c.users, "SELECT * FROM users")
add("scan_posts", lambda c: c.posts, "SELECT * FROM posts")
add("scan_comments", lambda c: c.comments, "SELECT * FROM comments")
add("scan_activity", lambda c: c.activity, "SELECT * FROM active")
add("scan_relationships", lambda c: c.relationships, "SELECT * FROM relationships")
add("point_lookup", lambda c: c.users.where("id = 7"), "SELECT * FROM users WHERE id = 7")
add(
    "lookup_by_name",
    lambda c: c.communities.where(F.lower("name") == "supplier#000000003"),
    "SELECT * FROM communities WHERE lower(name) = 'supplier#000000003'",
)
add("type_filter", lambda c: c.nodes.where(F.col("type").isin("community", "user")), "SELECT * FROM nodes WHERE type IN ('community', 'user')")
add(
    "watermark_filter",
    lambda c: relational.at_watermark(c.posts, "1996-06-30 00:00:00"),
    "SELECT * FROM posts WHERE coalesce(created_at, TIMESTAMP '1970-01-01') <= TIMESTAMP '1996-06-30'",
)
add(
    "changed_since",
    lambda c: relational.changed_since(c.posts, "1997-01-01").select("id"),
    "SELECT id FROM posts WHERE created_at > TIMESTAMP '1997-01-01'",
)
add(
    "changed_entity_counts",
    lambda c: relational.changed_since(c.posts, "1997-01-01").agg(F.count("*").alias("posts")).crossJoin(relational.changed_since(c.comments,
    "1997-01-01").agg(F.count("*").alias("comments"))),
    "SELECT (SELECT count(*) FROM posts WHERE created_at > TIMESTAMP '1997-01-01') AS posts, (SELECT count(*) FROM comments WHERE "
    "created_at > TIMESTAMP '1997-01-01') AS comments",
)
add(
    "affected_ids",
    lambda c: relational.changed_since(c.posts, "1998-01-01").select("author_id").union(relational.changed_since(c.comments, "1998-01-01")
    .select("author_id")).distinct(),
    "SELECT author_id FROM posts WHERE created_at > TIMESTAMP '1998-01-01' UNION SELECT author_id FROM comments WHERE created_at > "
    "TIMESTAMP '1998-01-01'",
)
add(
    "stale_filter",
    lambda c: c.posts.where(F.col("created_at") < F.lit("1998-08-01").cast("timestamp") - F.expr("INTERVAL 30 DAYS"))
    .select("id", ((F.unix_timestamp(F.lit("1998-08-01").cast("timestamp")) - F.unix_timestamp("created_at")) / 86400)
    .cast("int").alias("days")),
    "SELECT id, CAST(trunc((epoch(TIMESTAMP '1998-08-01') - epoch(created_at)) / 86400) AS INTEGER) AS days FROM posts WHERE "
    "created_at < TIMESTAMP '1998-08-01' - INTERVAL 30 DAY",
)
add(
    "json_path",
    lambda c: c.events.select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))
    .groupBy("k").agg(F.count("*").alias("n")),
    "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1",
)
add(
    "source_watermark",
    lambda c: relational.source_watermark(c.posts, c.comments),
    "SELECT greatest((SELECT max(created_at) FROM posts), (SELECT max(created_at) FROM comments)) AS watermark",
)
add(
    "mentions_of_pages",
    lambda c: c.table("pages").select("page_id", F.explode(C.links_of(F.col("html"))).alias("target"))
    .groupBy("page_id").agg(F.count("*").alias("n"), F.count_distinct("target").alias("targets")),
    "SELECT page_id, count(*) AS n, count(DISTINCT t) AS targets FROM (SELECT page_id, unnest(regexp_extract_all(html, "
    "'href=\"([^\"]+)\"', 1, 'i')) AS t FROM pages) GROUP BY 1",
)
add(
    "truncated_labels",
    lambda c: c.table("documents").select(F.col("doc_id").alias("id"), C.label(F.col("text"), F.concat(F.lit("Document "), F.col("doc_id")
    .cast("string"))).alias("label")),
    "SELECT doc_id AS id, coalesce(nullif(trim(left(regexp_replace(text, '\\s+', ' ', 'g'), 160)), ''), 'Document ' || doc_id) AS "
    "label FROM documents",
)
add(
    "schedules",
    lambda c: c.events.select("event_id", *(C.next_run(e, F.col("ts")).alias(n) for n, e in (("hourly", "@hourly"), ("daily", "@daily"), (
    "weekly", "@weekly"), ("monthly", "@monthly"), ("yearly", "@yearly"), ("every3", "@every 3d")))),
    "SELECT event_id, date_trunc('hour', ts) + INTERVAL 1 HOUR AS hourly, date_trunc('day', ts) + INTERVAL 1 DAY AS daily, "
    "CAST(date_trunc('day', ts) + (7 - dayofweek(ts)) * INTERVAL 1 DAY AS TIMESTAMP) AS weekly, date_trunc('month', ts) + INTERVAL 1 "
    "MONTH AS monthly, date_trunc('year', ts) + INTERVAL 1 YEAR AS yearly, ts + INTERVAL 3 DAY AS every3 FROM events",
)
add(
    "retry_backoff",
    lambda c: c.events.select("event_id", C.retry_minutes((F.col("event_id") % 15).cast("double")).alias("minutes")),
    "SELECT event_id, least(pow(2.0, event_id % 15), 1440.0) AS minutes FROM events",
)

# --- joins and aggregates
add("activity_rebuild", lambda c: relational.activity(c.posts, c.comments), "SELECT * FROM active")
add("overlap_self_join", lambda c: relational.overlap_pairs(c.activity), "SELECT * FROM pairs")
add(
    "overlap_pair",
    lambda c: relational.overlap_of(c.activity, 1, 2),
    "SELECT count(*) AS overlap_count FROM (SELECT user_id FROM active WHERE community_id = 1 INTERSECT SELECT user_id FROM active "
    "WHERE community_id = 2)",
)
add(
    "users_with_activity",
    lambda c: relational.users_with_activity(c.users, c.posts, c.comments),
    "SELECT id, username, CAST(coalesce(p, 0) + coalesce(k, 0) AS BIGINT) AS total_activity FROM users LEFT JOIN (SELECT author_id, "
    "count(*) AS p FROM posts GROUP BY 1) a ON id = a.author_id LEFT JOIN (SELECT author_id, count(*) AS k FROM comments GROUP BY 1) b "
    "ON id = b.author_id",
)
add(
    "user_activity_since",
    lambda c: relational.user_activity_since(c.users, c.posts, c.comments, "1998-01-01"),
    "SELECT id, username, CAST(coalesce(p, 0) + coalesce(k, 0) AS BIGINT) AS total_activity FROM users LEFT JOIN (SELECT author_id, "
    "count(*) AS p FROM posts WHERE created_at > TIMESTAMP '1998-01-01' GROUP BY 1) a ON id = a.author_id LEFT JOIN (SELECT author_id, "
    "count(*) AS k FROM comments WHERE created_at > TIMESTAMP '1998-01-01' GROUP BY 1) b ON id = b.author_id WHERE coalesce(p, 0) + "
    "coalesce(k, 0) > 0",
)
add(
    "user_communities",
    lambda c: relational.user_communities(c.communities, c.posts, c.comments, 7),
    "SELECT id, name FROM communities WHERE id IN (SELECT community_id FROM posts WHERE author_id = 7) OR id IN (SELECT community_id "
    "FROM comments WHERE author_id = 7)",
)
add(
    "user_activity_count",
    lambda c: c.activity.where("user_id = 7 and community_id <= 20").agg(F.coalesce(F.sum("activity_count"), F.lit(0))
    .alias("n")),
    "SELECT CAST(coalesce(sum(activity_count), 0) AS BIGINT) AS n FROM active WHERE user_id = 7 AND community_id <= 20",
)
add("count_by_type", lambda c: c.nodes.groupBy("type").agg(F.count("*").alias("n")), "SELECT type, count(*) AS n FROM nodes GROUP BY 1")
add(
    "database_stats",
    lambda c: integrity.report({"communities": c.communities, "users": c.users, "posts": c.posts, "comments": c.comments})
    .select("check", "count"),
    "SELECT 'communities' AS check, count(*) AS count FROM communities UNION ALL SELECT 'users', count(*) FROM users UNION ALL SELECT "
    "'posts', count(*) FROM posts UNION ALL SELECT 'comments', count(*) FROM comments",
)
add(
    "filtered_counts",
    lambda c: c.table("orders").agg(F.count("*").alias("total"), *(F.count_if(F.col("o_orderstatus") == s)
    .alias(f"n_{s.lower()}") for s in "FOP")),
    "SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_o, "
    "count(*) FILTER (WHERE o_orderstatus = 'P') AS n_p FROM orders",
)
add(
    "readiness_gate",
    lambda c: c.activity.agg(F.count_distinct("community_id").alias("n")).select("n", (F.col("n") >= 2)
    .alias("ready")),
    "SELECT n, n >= 2 AS ready FROM (SELECT count(DISTINCT community_id) AS n FROM active)",
)
add(
    "links_both_endpoints",
    lambda c: relational.links_among(c.links, relational.top_nodes(c.nodes, 500).select("id")),
    f"SELECT source, target FROM links WHERE source IN (SELECT id FROM weighted {_TOP} 500) AND target IN (SELECT id FROM weighted "
    f"{_TOP} 500)",
)
add(
    "links_among_capped",
    lambda c: relational.links_among(c.links, relational.top_nodes(c.nodes, 500).select("id"), 300),
    f"SELECT source, target FROM links WHERE source IN (SELECT id FROM weighted {_TOP} 500) AND target IN (SELECT id FROM weighted "
    f"{_TOP} 500) ORDER BY source, target LIMIT 300",
)
_GRAPH = (
    "SELECT 'node' AS data_type, id, name, val, type, NULL AS source, NULL AS target FROM k UNION ALL SELECT 'link', source || '->' || "
    "target, NULL, NULL, NULL, source, target FROM ")
add(
    "capped_graph",
    lambda c: relational.capped_graph(c.nodes, c.links, 2000, 5000),
    f"SELECT * FROM (WITH k AS (SELECT * FROM weighted {_TOP} 2000) {_GRAPH} (SELECT source, target FROM links WHERE source IN (SELECT "
    f"id FROM k) AND target IN (SELECT id FROM k) ORDER BY source, target LIMIT 5000))",
)
add(
    "capped_graph_typed",
    lambda c: relational.capped_graph(c.nodes, c.links, 1000, 3000, ["community", "user"]),
    f"SELECT * FROM (WITH k AS (SELECT * FROM weighted WHERE type IN ('community', 'user') {_TOP} 1000) {_GRAPH} (SELECT source, target "
    f"FROM links WHERE source IN (SELECT id FROM k) AND target IN (SELECT id FROM k) ORDER BY source, target LIMIT 3000))",
)
add("full_graph", lambda c: relational.full_graph(c.nodes, c.links), f"SELECT * FROM (WITH k AS (SELECT * FROM nodes) {_GRAPH} links)")
add(
    "cap_graph",
    lambda c: relational.cap_graph(c.nodes, c.links, 800, 2000),
    f"SELECT * FROM (WITH k AS (SELECT n.id, name, val, type FROM weighted n LEFT JOIN degree d ON n.id = d.id ORDER BY greatest(w, "
    f"coalesce(degree, 0)) DESC, n.id LIMIT 800) {_GRAPH} (SELECT source, target FROM links WHERE source IN (SELECT id FROM k) AND "
    f"target IN (SELECT id FROM k) ORDER BY source, target LIMIT 2000))",
)
add("degree_map", lambda c: relational.degrees(c.links), "SELECT * FROM degree")
add(
    "neighbours",
    lambda c: relational.neighbours(c.nodes, c.links, "community_3", 50),
    "SELECT n.id, name, val, type, degree FROM nodes n JOIN (SELECT id, count(*) AS degree FROM (SELECT target AS id FROM links WHERE "
    "source = 'community_3' UNION ALL SELECT source FROM links WHERE target = 'community_3') GROUP BY 1) d ON n.id = d.id ORDER BY "
    "degree DESC, n.id LIMIT 50",
)
add(
    "reciprocal_left_self_join",
    lambda c: relational.reciprocal(c.relationships),
    "SELECT u, v, overlap_count AS weight FROM pairs WHERE overlap_count >= 2",
)
add(
    "overlap_projection",
    lambda c: relational.overlap_projection(c.relationships),
    "SELECT u, v, overlap_count AS weight FROM pairs WHERE overlap_count >= 2",
)
_WL = (
    "SELECT source, target, weight FROM (SELECT * FROM (SELECT 'user_' || user_id AS source, 'community_' || community_id AS target, "
    "activity_count AS weight FROM active WHERE 'user_' || user_id IN (SELECT id FROM nodes) ORDER BY weight DESC, source, target "
    "LIMIT 1000) UNION ALL SELECT * FROM (SELECT 'community_' || source, 'community_' || target, overlap_count FROM relationships "
    "ORDER BY 3 DESC, 1, 2 LIMIT 1000) ORDER BY weight DESC, source, target LIMIT 1000)")
add(
    "materialize_workspace_links",
    lambda c: relational.workspace_links(c.activity, c.relationships, c.nodes, c.links.where("source = 'community_1'"), 1000),
    f"{_WL} WHERE source <> 'community_1'",
)
add(
    "author_cross_links",
    lambda c: relational.author_cross_links(c.posts, 3),
    "SELECT 'post_' || source AS source, 'post_' || target AS target FROM (SELECT a.id AS source, b.id AS target, row_number() OVER "
    "(PARTITION BY a.id ORDER BY b.id) AS k FROM posts a JOIN posts b ON a.author_id = b.author_id AND a.community_id <> "
    "b.community_id) WHERE k <= 3",
)
add(
    "detailed_content_graph",
    lambda c: relational.detailed_content(c.posts, c.comments, 10, 3),
    "SELECT * FROM (WITH s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY community_id ORDER BY created_at DESC, id) AS "
    "k FROM posts) WHERE k <= 10), t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY depth, id) AS k "
    "FROM comments WHERE post_id IN (SELECT id FROM s)) WHERE k <= 3) SELECT 'community_' || community_id AS source, 'post_' || id AS "
    "target, 'published' AS relation FROM s UNION ALL SELECT 'user_' || author_id, 'post_' || id, 'wrote' FROM s UNION ALL SELECT "
    "'post_' || post_id, 'comment_' || id, 'comment' FROM t UNION ALL SELECT 'user_' || author_id, 'comment_' || id, 'wrote' FROM t)",
)

# --- ranking, windows, pages
add("top_nodes", lambda c: relational.top_nodes(c.nodes, 1000), f"SELECT id, name, val, type FROM weighted {_TOP} 1000")
add(
    "keyset_page",
    lambda c: ranking.keyset_page(c.nodes, 100, (300, "post_1")),
    f"SELECT id, name, val, type FROM weighted WHERE w < 300 OR (w = 300 AND id > 'post_1') {_TOP} 101",
)
add(
    "offset_page",
    lambda c: ranking.offset_page(c.posts.select("id", "score"), [F.desc("score"), "id"], 50, 100),
    "SELECT id, score FROM posts ORDER BY score DESC, id LIMIT 50 OFFSET 100",
)
add(
    "typed_quota_topk",
    lambda c: ranking.typed_quota(c.nodes, {"community": 40, "user": 200, "post": 100, "comment": 0}, 300),
    "SELECT id, name, val, type FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY w DESC, id) AS k, CASE type WHEN "
    "'community' THEN 0 WHEN 'user' THEN 1 ELSE 2 END AS p FROM weighted) WHERE k <= CASE type WHEN 'community' THEN 40 WHEN 'user' "
    "THEN 200 ELSE 100 END ORDER BY p, w DESC, id LIMIT 300",
)
add(
    "distinct_on_best_anchor",
    lambda c: catalog.best_anchor(c.activity),
    "SELECT user_id, community_id, activity_count FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY activity_count "
    "DESC, community_id) AS k FROM active) WHERE k = 1",
)
add(
    "distinct_on_best_neighbour",
    lambda c: ranking.first_by(c.relationships, ["source"], [F.desc("overlap_count"), F.asc("target")]),
    "SELECT source, target, overlap_count FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY overlap_count DESC, target) "
    "AS k FROM relationships) WHERE k = 1",
)
add(
    "lateral_first_member",
    lambda c: publish.first_community(c.activity.select(F.col("user_id").alias("id"), "community_id")),
    "SELECT user_id AS id, min(community_id) AS community_id FROM active GROUP BY 1",
)
add(
    "lateral_topk_per_source",
    lambda c: search.lateral_top_links(c.relationships.withColumnRenamed("overlap_count", "weight"), c.communities.where("subscribers > 0")
    .select("id"), 2000),
    "SELECT source, target, overlap_count AS weight FROM relationships WHERE source IN (SELECT id FROM communities WHERE subscribers > "
    "0) AND target IN (SELECT id FROM communities WHERE subscribers > 0) ORDER BY weight DESC, source, target LIMIT 2000",
)
add(
    "topn_label",
    lambda c: ranking.top_names(c.communities.select("nation", F.col("subscribers").alias("value"), "name"), "nation"),
    "SELECT nation, string_agg(name, ' · ' ORDER BY k) AS label FROM (SELECT nation, name, row_number() OVER (PARTITION BY nation "
    "ORDER BY subscribers DESC, name) AS k FROM communities) WHERE k <= 3 GROUP BY 1",
)
add(
    "top_edges_per_node",
    lambda c: ranking.strongest_edges(c.relationships.where("source < target").select(F.col("source")
    .alias("u"), F.col("target").alias("v"), F.col("overlap_count").alias("weight")), 5, 1_000_000),
    "SELECT DISTINCT least(a, b) AS u, greatest(a, b) AS v, weight FROM (SELECT source AS a, target AS b, overlap_count AS weight, "
    "row_number() OVER (PARTITION BY source ORDER BY overlap_count DESC, target) AS k FROM relationships) WHERE k <= 5",
)
add(
    "activity_rank_beyond",
    lambda c: ranking.beyond(c.posts.select("id", "score"), [F.desc("score"), F.asc("id")], 1000),
    "SELECT id, score FROM posts WHERE id NOT IN (SELECT id FROM posts ORDER BY score DESC, id LIMIT 1000)",
)
add(
    "retention",
    lambda c: ranking.expired(c.posts.select("id"), 100, 3, c.comments.where("score = 7").select(F.col("post_id")
    .alias("id"))),
    "SELECT id FROM posts WHERE id NOT IN (SELECT id FROM posts ORDER BY id DESC LIMIT 100) AND id <> 3 AND id NOT IN (SELECT post_id "
    "FROM comments WHERE score = 7)",
)
add(
    "due_jobs",
    lambda c: ranking.due(c.events.select(F.col("event_id").alias("id"), (F.col("event_type") != "view")
    .alias("enabled"), F.col("ts").alias("next_run"), (F.col("event_id") % 5).alias("priority")), "2024-01-10"),
    "SELECT event_id AS id, event_type <> 'view' AS enabled, ts AS next_run, event_id % 5 AS priority FROM events WHERE event_type <> "
    "'view' AND ts <= TIMESTAMP '2024-01-10'",
)
add(
    "queue_selection",
    lambda c: c.events.orderBy(F.desc("value"), "ts", "event_id").limit(1).select("event_id"),
    "SELECT event_id FROM events ORDER BY value DESC, ts, event_id LIMIT 1",
)
add(
    "mutual_best_match",
    lambda c: ranking.mutual_best(c.activity.select(F.col("user_id").alias("new_id"), F.col("community_id")
    .alias("old_id"), F.col("activity_count").alias("weight"))),
    "SELECT user_id AS new_id, community_id AS old_id, activity_count AS weight FROM (SELECT *, row_number() OVER (PARTITION BY "
    "user_id ORDER BY activity_count DESC, community_id) AS f, row_number() OVER (PARTITION BY community_id ORDER BY activity_count "
    "DESC, user_id) AS b FROM active) WHERE f = 1 AND b = 1",
)


def _landmarks(c: Corpus) -> DataFrame:
    return c.points.groupBy(F.col("community_id").alias("id")).agg(F.count("*").alias("size"), F.round(F.sum(F.col("pos_x") * F.col("pos_x")),
        6).alias("distinctiveness")).select("id", (F.col("id") % 3).alias("macro_id"), "size", "distinctiveness", F.least(F.col("size") / 20.0,
        F.lit(1.0)).alias("confidence"), (F.col("id") % 2 == 0).alias("is_bridge"))


_SCORE = "0.30 * ln(1 + size) + 0.30 * distinctiveness + 0.25 * confidence + 0.15 * CAST(is_bridge AS DOUBLE)"
add(
    "landmark_score",
    lambda c: _landmarks(c).select("id", F.round(publish.landmark_score(), 5).alias("score")),
    f"SELECT id, round({_SCORE}, 5) AS score FROM landmarks",
)
add(
    "overview_rank",
    lambda c: ranking.overview_rank(_landmarks(c).withColumn("score", publish.landmark_score()), 2).select("id", "macro_id", F.col(
    "macro_rank").cast("long"), F.col("overview_rank").cast("long")),
    f"SELECT id, macro_id, macro_rank, row_number() OVER (ORDER BY CASE WHEN macro_rank <= 2 THEN 0 ELSE 1 END, CASE WHEN macro_rank <= "
    f"2 THEN macro_rank ELSE 0 END, score DESC, id) AS overview_rank FROM (SELECT *, row_number() OVER (PARTITION BY macro_id ORDER BY "
    f"score DESC, id) AS macro_rank FROM (SELECT *, {_SCORE} AS score FROM landmarks))",
)
add(
    "representative_clusters",
    lambda c: publish.representative_clusters(_landmarks(c), 3),
    "SELECT macro_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY k) AS clusters FROM (SELECT *, row_number() OVER (PARTITION BY "
    "macro_id ORDER BY distinctiveness DESC, confidence DESC, id) AS k FROM landmarks) WHERE k <= 3 GROUP BY 1",
)

# --- integrity, set operations, differences
add(
    "orphan_posts",
    lambda c: integrity.orphan_posts(c.all_posts, c.communities, c.users),
    "SELECT id FROM all_posts WHERE community_id IS NULL OR community_id NOT IN (SELECT id FROM communities) OR author_id NOT IN "
    "(SELECT id FROM users)",
)
add(
    "orphan_comments",
    lambda c: integrity.orphan_comments(c.comments, c.posts.where("id % 10 <> 0"), c.users),
    "SELECT id FROM comments WHERE post_id NOT IN (SELECT id FROM posts WHERE id % 10 <> 0) OR author_id NOT IN (SELECT id FROM users)",
)
add(
    "orphan_links",
    lambda c: integrity.orphan_links(c.links, c.nodes.where("type <> 'user'")),
    "SELECT DISTINCT source, target FROM links WHERE source LIKE 'user%'",
)
add(
    "orphan_nodes",
    lambda c: integrity.orphan_nodes(c.nodes, c.links.where("source not like 'user%'")),
    "SELECT id, type FROM nodes WHERE id NOT IN (SELECT source FROM links WHERE source NOT LIKE 'user%' UNION SELECT target FROM links "
    "WHERE source NOT LIKE 'user%')",
)
add("lost_replies", lambda c: integrity.lost_replies(c.comments.where("depth <> 1")), "SELECT id, parent_id FROM comments WHERE depth = 2")
add(
    "orphan_deletes",
    lambda c: integrity.sound(c.all_posts, integrity.orphan_posts(c.all_posts, c.communities, c.users), ["id"])
    .select("id"),
    "SELECT id FROM posts",
)
add(
    "integrity_report",
    lambda c: integrity.report({"posts": integrity.orphan_posts(c.all_posts, c.communities, c.users), "nodes": integrity.orphan_nodes(c.nodes,
    c.links)}),
    "SELECT 'posts' AS check, (SELECT count(*) FROM all_posts WHERE community_id IS NULL) AS count, (SELECT count(*) FROM all_posts "
    "WHERE community_id IS NULL) > 0 AS has_issues UNION ALL SELECT 'nodes', (SELECT count(*) FROM nodes WHERE id NOT IN (SELECT id "
    "FROM degree)), (SELECT count(*) FROM nodes WHERE id NOT IN (SELECT id FROM degree)) > 0",
)
add(
    "bulk_upsert_nodes",
    lambda c: integrity.upserted(c.nodes, c.nodes.where("type = 'user'").withColumn("val", F.lit("9")), "id", F.lit(1))
    .groupBy("type", "val").agg(F.count("*").alias("n")),
    "SELECT type, CASE WHEN type = 'user' THEN '9' ELSE val END AS val, count(*) AS n FROM nodes GROUP BY ALL",
)
add(
    "bulk_insert_links",
    lambda c: integrity.insertable_links(c.links.union(c.links).unionByName(c.links.select(F.col("source"), F.lit("nowhere")
    .alias("target"))), c.nodes, c.links.where("source like 'user%'")),
    "SELECT DISTINCT source, target FROM links WHERE source NOT LIKE 'user%'",
)
add(
    "batch_update_positions",
    lambda c: integrity.moved(c.points, c.points.select("id", (F.col("pos_x") + F.when(F.col("community_id") < 5, 1.0)
    .otherwise(1e-5)).alias("pos_x"), "pos_y", "pos_z"), 1e-3).select("id", _r("pos_x"), _r("pos_y"), _r("pos_z")),
    "SELECT id, round(pos_x + CASE WHEN community_id < 5 THEN 1.0 ELSE 0.0 END, 6) AS pos_x, round(pos_y, 6) AS pos_y, round(pos_z, 6) "
    "AS pos_z FROM points",
)
add(
    "revision_diff",
    lambda c: integrity.one_sided(c.nodes.where("type <> 'user'"), c.nodes.where("type <> 'post'"), "id"),
    "SELECT CASE WHEN type = 'user' THEN 'add' ELSE 'remove' END AS action, id FROM nodes WHERE type IN ('user', 'post')",
)
add(
    "snapshot_diff",
    lambda c: integrity.snapshot_diff(c.points.where("community_id <> 0"), c.points.where("community_id <> 1")
    .withColumn("pos_x", F.when(F.col("community_id") == 2, F.col("pos_x") + 0.5).when(F.col("community_id") == 3, F.col("pos_x") + 1e-6)
    .otherwise(F.col("pos_x")))),
    "SELECT CASE community_id WHEN 0 THEN 'add' WHEN 1 THEN 'remove' ELSE 'update' END AS action, id FROM points WHERE community_id IN "
    "(0, 1, 2)",
)
add(
    "union_distinct",
    lambda c: c.posts.select("author_id").union(c.comments.select("author_id")).distinct(),
    "SELECT author_id FROM posts UNION SELECT author_id FROM comments",
)


def _matches(c: Corpus) -> DataFrame:
    return c.activity.where("activity_count >= 3").select(F.col("user_id").alias("new_id"), F.col("community_id").alias("old_id"))


_M = "(SELECT user_id AS new_id, community_id AS old_id FROM active WHERE activity_count >= 3)"
add(
    "identity_events",
    lambda c: integrity.identity_events(_matches(c), c.communities.select(F.col("id").alias("old_id")), c.users.select(F.col("id")
    .alias("new_id"))).select("event", F.array_join(F.col("old_ids").cast("array<string>"), ",").alias("old_ids"), F.array_join(F.col(
    "new_ids").cast("array<string>"), ",").alias("new_ids")),
    f"SELECT 'merge' AS event, string_agg(CAST(old_id AS VARCHAR), ',' ORDER BY old_id) AS old_ids, CAST(new_id AS VARCHAR) AS new_ids "
    f"FROM {_M} GROUP BY new_id HAVING count(*) > 1 UNION ALL SELECT 'split', CAST(old_id AS VARCHAR), string_agg(CAST(new_id AS "
    f"VARCHAR), ',' ORDER BY new_id) FROM {_M} GROUP BY old_id HAVING count(*) > 1 UNION ALL SELECT 'new', '', CAST(id AS VARCHAR) FROM "
    f"users WHERE id NOT IN (SELECT new_id FROM {_M}) UNION ALL SELECT 'retired', CAST(id AS VARCHAR), '' FROM communities WHERE id NOT "
    f"IN (SELECT old_id FROM {_M})",
)
add(
    "latest_suppressions",
    lambda c: publish.newest(c.events.select("user_id", "event_id", "event_type"), "user_id", "event_id"),
    "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM "
    "events) WHERE k = 1",
)

# --- affinity
add("affinity_candidates", lambda c: affinity.candidates(c.relationships, c.cross_references), "SELECT * FROM cand")
add(
    "marginals",
    lambda c: affinity.marginals(c.activity, c.posts, c.cross_references),
    "SELECT id, CAST(m_active AS BIGINT) AS m_active, CAST(m_authors AS BIGINT) AS m_authors, CAST(m_repeat AS BIGINT) AS m_repeat, "
    "CAST(m_cross AS BIGINT) AS m_cross FROM marg",
)
add(
    "totals",
    lambda c: affinity.totals(c.activity, c.posts, c.cross_references),
    "SELECT t_active, t_authors, CAST(t_repeat AS BIGINT) AS t_repeat, t_cross FROM univ",
)
add(
    "evidence_star_join",
    lambda c: affinity.pair_evidence(affinity.candidates(c.relationships, c.cross_references), c.activity, c.posts, c.cross_references),
    "SELECT u, v, o_active, o_authors, CAST(o_repeat AS BIGINT) AS o_repeat, o_cross FROM evid",
)


def _affinity(c: Corpus) -> DataFrame:
    return affinity.affinity(c.activity, c.posts, c.cross_references)


_RAW = [f"raw_{k}" for k in affinity.LAYERS]
add(
    "affinity_score",
    lambda c: _affinity(c).select("u", "v", *map(_r, [*_RAW, "affinity"])),
    "SELECT u, v, " + ", ".join(f"round({k}, 6) AS {k}" for k in [*_RAW, "affinity"]) + " FROM aff",
)
add(
    "layers_from_pairs",
    lambda c: affinity.layers_of(_affinity(c)).groupBy("layer").agg(F.count("*").alias("n"), F.round(F.max("weight"), 6)
    .alias("weight")),
    "SELECT * FROM (WITH s AS (" + " UNION ALL ".join(f"SELECT '{k}' AS layer, {w} AS w, raw_{k} AS raw FROM aff WHERE raw_{k} > 0" for k, w in affinity.LAYERS.items())
    + ") SELECT layer, count(*) AS n, round(max(w) / (SELECT sum(w) FROM (SELECT DISTINCT layer, w FROM s)), 6) AS weight FROM s GROUP "
    "BY 1)",
)


def _groups(c: Corpus) -> DataFrame:
    return c.communities.select("id", F.col("nation").alias("group_id"))


add(
    "affinity_routes",
    lambda c: affinity.group_routes(_affinity(c), _groups(c)).select("source", "target", _r("total", 4), _r("affinity", 5), "edge_count"),
    "SELECT least(a.group_id, b.group_id) AS source, greatest(a.group_id, b.group_id) AS target, round(sum(affinity), 4) AS total, "
    "round(least(avg(affinity), 1.0), 5) AS affinity, count(*) AS edge_count FROM aff JOIN groups a ON u = a.id JOIN groups b ON v = "
    "b.id WHERE a.group_id <> b.group_id GROUP BY 1, 2",
)
add(
    "macro_affinity_share",
    lambda c: affinity.macro_share(_affinity(c), _groups(c)).select("id", _r("primary_share", 5), _r("secondary_share", 5)),
    "SELECT * FROM (WITH e AS (SELECT u AS id, v AS other, affinity FROM aff UNION ALL SELECT v, u, affinity FROM aff), s AS (SELECT "
    "e.id, o.group_id AS own, g.group_id, sum(affinity) AS s, sum(sum(affinity)) OVER (PARTITION BY e.id) AS t FROM e JOIN groups g ON "
    "other = g.id JOIN groups o ON e.id = o.id GROUP BY 1, 2, 3) SELECT id, round(coalesce(sum(CASE WHEN group_id = own THEN s / t "
    "END), 0.0), 5) AS primary_share, round(coalesce(max(CASE WHEN group_id <> own THEN s / t END), 0.0), 5) AS secondary_share FROM s "
    "GROUP BY 1)",
)

# --- space
_SPOT = "SELECT id, name, val, type, community_id, pos_x, pos_y, pos_z FROM points"
add("bbox_3d", lambda c: spatial.box_page(c.points, _BOX, 100), f"{_SPOT} WHERE {_IN_BOX} ORDER BY {_PW} DESC, id LIMIT 100")
add(
    "bbox_2d",
    lambda c: spatial.box_page(c.points, _BOX, 100, flat=True),
    f"{_SPOT} WHERE pos_x BETWEEN -0.5 AND 0.5 AND pos_y BETWEEN -0.4 AND 0.6 ORDER BY {_PW} DESC, id LIMIT 100",
)
add("bbox_count", lambda c: spatial.box(c.points, _BOX).agg(F.count("*").alias("n")), f"SELECT count(*) AS n FROM points WHERE {_IN_BOX}")


def _suppressed(c: Corpus) -> DataFrame:
    return c.points.where("community_id = 3").select(F.col("id").alias("entity_id"), F.when(F.col("type") == "user", F.lit("2024-01-01")
        .cast("timestamp")).alias("restored_at"))


add(
    "suppression_overlay",
    lambda c: spatial.visible(c.points, _suppressed(c)).select("id"),
    "SELECT id FROM points WHERE NOT (community_id = 3 AND type <> 'user')",
)
add(
    "region_lod",
    lambda c: spatial.region(c.points, _suppressed(c), _BOX, "medium", 40, 5).select("id"),
    f"SELECT id FROM points WHERE {_IN_BOX} AND type IN ('community', 'user') AND NOT (community_id = 3 AND type <> 'user') ORDER BY "
    f"{_PW} DESC, id LIMIT 40 OFFSET 5",
)
add(
    "centroids",
    lambda c: spatial.centroids(c.points).select("community_id", "n", _r("pos_x"), _r("pos_y"), _r("pos_z")),
    "SELECT community_id, count(*) AS n, round(avg(pos_x), 6) AS pos_x, round(avg(pos_y), 6) AS pos_y, round(avg(pos_z), 6) AS pos_z "
    "FROM points GROUP BY 1",
)
add(
    "community_supernodes",
    lambda c: spatial.supernodes(c.points.select("community_id").distinct().union(c.spark.range(1).select(F.lit(99))), c.points)
    .select("community_id", "size", _r("pos_x")),
    "SELECT community_id, count(*) AS size, round(avg(pos_x), 6) AS pos_x FROM points GROUP BY 1 UNION ALL SELECT 99, 0, 0.0",
)
add(
    "bounds",
    lambda c: spatial.bounds(c.points),
    "SELECT count(*) AS n, " + ", ".join(f"{f}(pos_{a}) AS {f}_{a}" for a in "xyz" for f in ("min", "max")) + " FROM points",
)
add(
    "percentile_radius",
    lambda c: spatial.radius_quantile(c.points).select(_r("radius")),
    "SELECT round(quantile_disc(sqrt(pos_x * pos_x + pos_y * pos_y + pos_z * pos_z), 0.95), 6) AS radius FROM points",
)
add(
    "directional_nearest",
    lambda c: spatial.directional_nearest(c.points, ("point_0", 0.0, 0.0), "x", 1).select("id"),
    "SELECT id FROM points WHERE id <> 'point_0' AND pos_x > 0 ORDER BY sqrt(pos_x * pos_x + pos_y * pos_y) + 0.7 * abs(pos_y), id "
    "LIMIT 1",
)
add(
    "octree_sphere",
    lambda c: spatial.in_sphere(c.points, (0.0, 0.0, 0.0), 0.2).select("id"),
    "SELECT id FROM points WHERE pos_x * pos_x + pos_y * pos_y + pos_z * pos_z <= 0.04000000000000001",
)
add(
    "octree_frustum",
    lambda c: spatial.in_frustum(c.points, [(1.0, 0.0, 0.0, 0.1), (0.0, -1.0, 0.5, 0.2)]).select("id"),
    "SELECT id FROM points WHERE pos_x + 0.1 >= 0 AND -pos_y + 0.5 * pos_z + 0.2 >= 0",
)
add(
    "octree_ray",
    lambda c: spatial.near_ray(c.points, (0.0, 0.0, 0.0), (1.0, 0.0, 0.0), 0.1).select("id"),
    "SELECT id FROM points WHERE pos_x >= 0 AND pos_y * pos_y + pos_z * pos_z <= 0.01",
)
add(
    "lod_tiers",
    lambda c: c.points.select("id", spatial.detail_tier(F.abs("pos_x") * 10_000).alias("tier")),
    "SELECT id, CASE WHEN abs(pos_x) * 10000 < 500 THEN 'high' WHEN abs(pos_x) * 10000 < 1000 THEN 'medium' WHEN abs(pos_x) * 10000 < "
    "2000 THEN 'low' ELSE 'hidden' END AS tier FROM points",
)


def _chain(c: Corpus) -> DataFrame:
    """Links between consecutive points."""
    n = F.regexp_extract("id", "[0-9]+", 0).cast("int")
    return c.points.where(n > 0).select(F.concat(F.lit("point_"), (n - 1).cast("string")).alias("source"), F.col("id").alias("target"))


_CHAIN = "(SELECT 'point_' || (vec_id - 1) AS source, 'point_' || vec_id AS target FROM embeddings WHERE vec_id > 0)"
_BW = (
    f"SELECT least(a.community_id, b.community_id) AS source, greatest(a.community_id, b.community_id) AS target, count(*) AS weight "
    f"FROM {_CHAIN} l JOIN points a ON l.source = a.id JOIN points b ON l.target = b.id WHERE a.community_id <> b.community_id GROUP BY "
    f"1, 2")
add("inter_community_links", lambda c: spatial.bundle_weights(_chain(c), c.points), _BW)
add(
    "edge_bundles",
    lambda c: spatial.bundles(spatial.bundle_weights(_chain(c), c.points), spatial.centroids(c.points))
    .select("source", "target", "weight", _r("control_x", 5), _r("control_y", 5), _r("control_z", 5)),
    f"SELECT * FROM (WITH w AS ({_BW}), k AS (SELECT community_id, avg(pos_x) AS x, avg(pos_y) AS y, avg(pos_z) AS z FROM points GROUP "
    f"BY 1) SELECT w.source, w.target, weight, round((a.x + b.x) / 2 - 0.2 * (b.y - a.y), 5) AS control_x, round((a.y + b.y) / 2 + 0.2 "
    f"* (b.x - a.x), 5) AS control_y, round((a.z + b.z) / 2, 5) AS control_z FROM w JOIN k a ON a.community_id = w.source JOIN k b ON "
    f"b.community_id = w.target)",
)
add(
    "edge_cosine_weights",
    lambda c: spatial.cosine_weights(relational.overlap_projection(c.relationships)).select("u", "v", _r("weight")),
    "SELECT * FROM (WITH p AS (SELECT u, v, overlap_count AS w FROM pairs WHERE overlap_count >= 2), s AS (SELECT id, sum(w) AS s FROM "
    "(SELECT u AS id, w FROM p UNION ALL SELECT v, w FROM p) GROUP BY 1) SELECT u, v, round(w / sqrt(a.s * b.s), 6) AS weight FROM p "
    "JOIN s a ON u = a.id JOIN s b ON v = b.id)",
)
add(
    "community_density",
    lambda c: client.density(_chain(c), c.points).select("community_id", "n", _r("density")),
    f"SELECT p.community_id, count(*) AS n, round(CASE WHEN count(*) < 2 THEN 0.0 ELSE coalesce(max(k), 0) / (count(*) * (count(*) - 1) "
    f"/ 2) END, 6) AS density FROM points p LEFT JOIN (SELECT a.community_id, count(*) AS k FROM {_CHAIN} l JOIN points a ON l.source = "
    f"a.id JOIN points b ON l.target = b.id WHERE a.community_id = b.community_id GROUP BY 1) i ON i.community_id = p.community_id "
    f"GROUP BY 1",
)

# --- what an explorer computes
add(
    "metric_active_users",
    lambda c: client.active_users(c.links),
    "SELECT target AS id, count(DISTINCT source) AS active_users FROM links WHERE source LIKE 'user%' GROUP BY 1",
)
add(
    "metric_inter_community_links",
    lambda c: client.community_links(c.links),
    "SELECT id, count(*) AS n_links FROM (SELECT source AS id FROM links WHERE source LIKE 'community%' UNION ALL SELECT target FROM "
    "links WHERE source LIKE 'community%') GROUP BY 1",
)
add(
    "metric_content_activity",
    lambda c: client.content_activity(c.posts, c.comments),
    "SELECT p.community_id, count(DISTINCT p.id) + count(k.id) AS content FROM posts p LEFT JOIN comments k ON k.post_id = p.id GROUP "
    "BY 1",
)
add(
    "metric_subscribers",
    lambda c: c.nodes.where("type = 'community'").select("id", C.weight().alias("subscribers")),
    "SELECT id, w AS subscribers FROM weighted WHERE type = 'community'",
)
add(
    "user_metric",
    lambda c: client.user_metric(c.posts, c.comments),
    "SELECT author_id, CAST(sum(w) AS DOUBLE) AS metric FROM (SELECT author_id, 1.5 AS w FROM posts UNION ALL SELECT author_id, 1.0 "
    "FROM comments) GROUP BY 1",
)
add(
    "degree_filter",
    lambda c: client.with_degree(c.nodes, c.links, 5, 60),
    f"SELECT * FROM (WITH k AS (SELECT n.* FROM nodes n LEFT JOIN degree d ON n.id = d.id WHERE coalesce(degree, 0) BETWEEN 5 AND 60) "
    f"{_GRAPH} (SELECT * FROM links WHERE source IN (SELECT id FROM k) AND target IN (SELECT id FROM k)))",
)
add("linked_only", lambda c: client.linked_only(c.nodes, c.links), "SELECT * FROM nodes WHERE type = 'community' OR id IN (SELECT id FROM degree)")
add(
    "label_set",
    lambda c: client.labels(c.nodes, c.links),
    "SELECT n.id, greatest(w, coalesce(degree, 0)) AS value FROM weighted n LEFT JOIN degree d ON n.id = d.id WHERE type IN "
    "('community', 'user') ORDER BY value DESC, n.id LIMIT 200",
)

# --- search, catalog, trees


def _docs(c: Corpus) -> DataFrame:
    l_ = c.table("labels").select("doc_id", "toxic")
    return c.table("documents").join(l_, "doc_id", "left").select(F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1)
        .alias("title"), F.col("text").alias("body"), "lang", "source", (F.coalesce("toxic", F.lit(0)) == 1)
        .alias("sensitive"))


_TOK = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda x: x <> ''))"
_MATCH = "(len(list_intersect(" + _TOK.format("title || ' ' || body") + ", ['the', 'license'])) = 2 OR contains(lower(title), 'the license'))"
add(
    "search_legacy",
    lambda c: search.contains(c.nodes, "000012", 100),
    f"SELECT id, name, val, type, CASE WHEN lower(name) = '000012' THEN 0 WHEN lower(id) = '000012' THEN 1 ELSE 2 END AS rank FROM "
    f"weighted WHERE contains(lower(name), '000012') OR contains(lower(id), '000012') ORDER BY rank, w DESC, id LIMIT 100",
)
add(
    "search_tiered",
    lambda c: search.tiered(c.nodes, "customer#00000001", 60),
    "SELECT id, name, val, type, CASE WHEN id = 'customer#00000001' THEN 2 WHEN lower(left(name, 128)) = 'customer#00000001' THEN 1 "
    "ELSE 0 END AS tier FROM weighted WHERE starts_with(lower(left(name, 128)), 'customer#00000001') ORDER BY tier DESC, w DESC, id "
    "LIMIT 60",
)
add(
    "catalog_filter",
    lambda c: search.matching(_docs(c), "the license", lang="en", source="").select("id"),
    f"SELECT id FROM docs WHERE {_MATCH} AND lang = 'en'",
)
add(
    "catalog_relevance",
    lambda c: search.catalog(_docs(c), "the license", 50).select("id", F.round("relevance", 6).alias("relevance")),
    "SELECT id, CAST(round(len(list_intersect(" + _TOK.format("title") + ", ['the', 'license'])) * 1.0 + len(list_intersect(" + _TOK.format(
    "body") + f", ['the', 'license'])) * 0.2 + CASE WHEN lower(title) = 'the license' THEN 2.0 WHEN starts_with(lower(title), 'the license') THEN "
    f"1.0 ELSE 0.0 END, 6) AS DOUBLE) AS relevance FROM docs WHERE {_MATCH} ORDER BY relevance DESC, id LIMIT 50",
)
add("catalog_facets", lambda c: search.facets(_docs(c), "the license", "source"), f"SELECT source, count(*) AS n FROM docs WHERE {_MATCH} GROUP BY 1")
add(
    "exact_total",
    lambda c: search.matching(_docs(c), "the license").agg(F.count("*").alias("total")),
    f"SELECT count(*) AS total FROM docs WHERE {_MATCH}",
)
add("snippet", lambda c: search.snippet(_docs(c)), "SELECT id, CASE WHEN NOT sensitive THEN left(title || ' ' || body, 240) END AS snippet FROM docs")
add(
    "tombstones",
    lambda c: catalog.tombstoned(_docs(c).withColumns({"removed": F.col("sensitive"), "deleted": F.col("id") % 10 == 0})),
    "SELECT id, CASE WHEN NOT (sensitive OR id % 10 = 0) THEN title END AS title, CASE WHEN NOT (sensitive OR id % 10 = 0) THEN body "
    "END AS body FROM docs",
)
add(
    "tfidf_topics",
    lambda c: search.topics(c.table("documents").select("source", "text"), "source", ["the", "and"], 5)
    .select("source", "token", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank")),
    "SELECT * FROM (WITH t AS (SELECT source, token, count(*) AS tf FROM (SELECT source, unnest(regexp_split_to_array(lower(text), "
    "'[^a-z0-9]+')) AS token FROM documents) WHERE length(token) >= 3 AND token NOT IN ('the', 'and') GROUP BY 1, 2), f AS (SELECT "
    "token, count(*) AS df FROM t GROUP BY 1), s AS (SELECT source, token, tf * ln((1 + (SELECT count(DISTINCT source) FROM "
    "documents)) / (1 + df)) AS score FROM t JOIN f USING (token)) SELECT source, token, round(score, 6) AS score, rank FROM (SELECT "
    "*, row_number() OVER (PARTITION BY source ORDER BY score DESC, token) AS rank FROM s) WHERE rank <= 5)",
)
add(
    "catalog_tree",
    lambda c: search.tree(c.comments, "t3_5"),
    "SELECT c.id, score, coalesce(n, 0) AS child_count FROM comments c LEFT JOIN (SELECT parent_id, count(*) AS n FROM comments GROUP "
    "BY 1) k ON k.parent_id = 't1_' || c.id WHERE c.parent_id = 't3_5'",
)
add(
    "entity_thread",
    lambda c: search.thread(c.comments.select("id", F.when(F.col("depth") == 0, F.col("parent_id")).otherwise(F.expr(
    "substring(parent_id, 4)")).alias("parent_id"), F.col("score").alias("value")), "t3_5", 3, 250),
    "SELECT id, score AS value, depth + 1 AS depth FROM comments WHERE post_id = 5 AND depth < 3 ORDER BY 3, value DESC, id LIMIT 250",
)
add(
    "entity_neighbourhood",
    lambda c: search.neighbourhood(c.relationships.select(F.col("source").cast("string"), F.col("target")
    .cast("string"), F.col("overlap_count").alias("weight")), "3", 30),
    "SELECT id, priority FROM (SELECT '3' AS id, NULL AS priority UNION ALL SELECT CAST(target AS VARCHAR), overlap_count FROM "
    "relationships WHERE source = 3) ORDER BY priority DESC NULLS FIRST, id LIMIT 30",
)
add(
    "entity_discussion",
    lambda c: ranking.offset_page(c.comments.where("parent_id = 't3_5'").select("id", "score"), [F.desc("score"), "id"], 50, 0),
    "SELECT id, score FROM comments WHERE parent_id = 't3_5'",
)
add(
    "telemetry_top",
    lambda c: search.heaviest(c.nodes, ["community"], 20),
    "SELECT id, w AS value FROM weighted WHERE type = 'community' ORDER BY w DESC, id LIMIT 20",
)
add(
    "sitemap",
    lambda c: search.sitemap(c.posts.select("id", F.col("created_at").alias("updated_at")), 5000),
    "SELECT CAST((k - 1) // 5000 AS INTEGER) AS shard, count(*) AS entries, CAST(max(created_at) AS DATE) AS updated FROM (SELECT *, "
    "row_number() OVER (ORDER BY id) AS k FROM posts) GROUP BY 1",
)

# --- catalog and revisions
add(
    "user_metrics",
    lambda c: catalog.user_metrics(c.users, c.posts, c.comments),
    "SELECT u.id, coalesce(p, 0) AS n_posts, coalesce(k, 0) AS n_comments, coalesce(q, 0) AS n_communities, coalesce(p, 0) + "
    "coalesce(k, 0) AS total FROM users u LEFT JOIN (SELECT author_id, count(*) AS p FROM posts GROUP BY 1) a ON a.author_id = u.id "
    "LEFT JOIN (SELECT author_id, count(*) AS k FROM comments GROUP BY 1) b ON b.author_id = u.id LEFT JOIN (SELECT user_id, count(*) "
    "AS q FROM active GROUP BY 1) d ON d.user_id = u.id",
)


def _bots(c: Corpus) -> DataFrame:
    return catalog.automated(c.users, c.activity, ["customer#000000009"], c.users.where("id % 50 = 0")
        .select(F.col("id").alias("user_id"), (F.col("id") % 100 == 0).alias("automated")))


_BOT = "(SELECT id FROM users WHERE CASE WHEN id % 50 = 0 THEN id % 100 = 0 ELSE lower(username) = 'customer#000000009' END)"
add("automated_users", _bots, f"SELECT id FROM {_BOT}")
add(
    "community_metrics",
    lambda c: catalog.community_metrics(c.communities, c.posts, c.comments, _bots(c)),
    f"SELECT c.id, coalesce(p, 0) AS n_posts, coalesce(k, 0) AS n_comments, coalesce(q, 0) AS n_authors FROM communities c LEFT JOIN "
    f"(SELECT community_id, count(*) FILTER (WHERE t = 'p') AS p, count(*) FILTER (WHERE t = 'c') AS k, count(DISTINCT author_id) AS q "
    f"FROM (SELECT community_id, author_id, 'p' AS t FROM posts WHERE author_id NOT IN {_BOT} UNION ALL SELECT community_id, author_id, "
    f"'c' FROM comments WHERE author_id NOT IN {_BOT} AND post_id NOT IN (SELECT id FROM posts WHERE author_id IN {_BOT})) GROUP BY 1) "
    f"m ON m.community_id = c.id",
)
add(
    "post_metrics",
    lambda c: catalog.post_metrics(c.posts, c.comments),
    "SELECT p.id, count(k.id) AS n_comments, count(k.id) FILTER (WHERE k.parent_id LIKE 't3_%') AS n_top, count(k.id) FILTER (WHERE "
    "k.parent_id LIKE 't1_%') AS n_replies FROM posts p LEFT JOIN comments k ON k.post_id = p.id GROUP BY 1",
)
add(
    "comment_metrics",
    lambda c: catalog.comment_metrics(c.comments),
    "SELECT c.id, coalesce(n, 0) AS n_replies FROM comments c LEFT JOIN (SELECT parent_id, count(*) AS n FROM comments GROUP BY 1) k "
    "ON k.parent_id = 't1_' || c.id",
)
add("catalog_entities", lambda c: catalog.entities(c.communities, c.users, c.posts, c.comments, c.activity), "SELECT * FROM ents")


def _entities(c: Corpus) -> DataFrame:
    return catalog.entities(c.communities, c.users, c.posts, c.comments, c.activity)


add("structural_links", lambda c: catalog.structural_links(_entities(c)), "SELECT * FROM structural")
add(
    "quantiles_by_type",
    lambda c: catalog.quantiles(_entities(c)),
    "SELECT type, quantile_disc(value, 0.05) AS low, quantile_disc(value, 0.95) AS high FROM ents GROUP BY 1",
)
add(
    "validation_gates",
    lambda c: catalog.validation(_entities(c)),
    "SELECT count(*) AS n, count(*) FILTER (WHERE label = '') AS empty_labels, count(*) FILTER (WHERE type = 'community') AS "
    "n_community, count(*) FILTER (WHERE type = 'user') AS n_user, count(*) FILTER (WHERE type = 'post') AS n_post, count(*) FILTER "
    "(WHERE type = 'comment') AS n_comment, count(*) FILTER (WHERE label = '') = 0 AND count(*) > 0 AS passed FROM ents",
)
add(
    "checksum",
    lambda c: catalog.checksum(_entities(c), "c1", "w1"),
    "SELECT counts, sha256('c1:w1:' || counts) AS checksum FROM (SELECT string_agg(type || '=' || n, ',' ORDER BY type) AS counts FROM "
    "(SELECT type, count(*) AS n FROM ents GROUP BY 1))",
)
add(
    "warm_start",
    lambda c: catalog.warm_start(c.points.select("id", F.lit("point_1").alias("anchor_id")), c.points.where("community_id < 5"), c.points.where(
    "id = 'point_1' and community_id >= 0")).select("id", "provenance", _r("pos_x")),
    "SELECT id, CASE WHEN community_id < 5 THEN 'warm-start' ELSE 'community-seeded' END AS provenance, round(CASE WHEN community_id < "
    "5 THEN pos_x ELSE (SELECT pos_x FROM points WHERE id = 'point_1') END, 6) AS pos_x FROM points",
)
add(
    "revision_typed_projection",
    lambda c: publish.typed_projection(_entities(c), c.activity, c.relationships, catalog.structural_links(_entities(c)), 4000),
    "SELECT * FROM (SELECT 'user_' || user_id AS source, 'community_' || community_id AS target, 'user_activity' AS relation, true AS "
    "directed, activity_count AS weight FROM active UNION ALL SELECT 'community_' || u, 'community_' || v, 'overlap', false, "
    "overlap_count FROM pairs WHERE overlap_count >= 2 UNION ALL SELECT source, target, relation, true, 1 FROM structural) ORDER BY "
    "weight DESC, source, target, relation LIMIT 4000",
)
add(
    "community_routes",
    lambda c: affinity.group_routes(relational.overlap_projection(c.relationships).select("u", "v", F.col("weight")
    .alias("affinity")), _groups(c)).select("source", "target", "total", "edge_count"),
    "SELECT least(a.group_id, b.group_id) AS source, greatest(a.group_id, b.group_id) AS target, CAST(sum(overlap_count) AS BIGINT) AS "
    "total, count(*) AS edge_count FROM pairs JOIN groups a ON u = a.id JOIN groups b ON v = b.id WHERE overlap_count >= 2 AND "
    "a.group_id <> b.group_id GROUP BY 1, 2",
)
add(
    "stable_ids",
    lambda c: publish.stable_ids(c.points.select("id", F.col("community_id").alias("group_id")), c.points.select("id", (F.col("community_id")
    + 10).cast("int").alias("group_id"))),
    "SELECT community_id + 10 AS group_id, CAST(community_id AS VARCHAR) AS stable_id FROM points GROUP BY 1, 2",
)

# --- graph kernels


def _point_links(c: Corpus) -> DataFrame:
    n = F.regexp_extract("id", "[0-9]+", 0).cast("int")
    return c.points.where(n >= 10).select(F.concat(F.lit("point_"), (n - 10).cast("string")).alias("u"), F.col("id")
        .alias("v"), F.lit(1).alias("weight"))


add(
    "modularity",
    lambda c: communities.modularity(_point_links(c), c.points.select("id", "community_id")).select(_r("modularity", 8)),
    "SELECT * FROM (WITH e AS (SELECT 'point_' || (vec_id - 10) AS a, 'point_' || vec_id AS b FROM embeddings WHERE vec_id >= 10), s "
    "AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), m AS (SELECT count(*) AS m2 FROM s), d AS (SELECT a AS id, count(*) AS d "
    "FROM s GROUP BY 1), k AS (SELECT community_id, sum(d) AS k FROM d JOIN points USING (id) GROUP BY 1), i AS (SELECT count(*) AS w "
    "FROM s JOIN points p ON a = p.id JOIN points q ON b = q.id WHERE p.community_id = q.community_id) SELECT round(w / m2 - (SELECT "
    "sum(k * k) FROM k) / (m2 * m2), 8) AS modularity FROM m, i)",
)


add("label_propagation", lambda c: communities.label_propagation(_point_links(c)))
add("louvain_hierarchy", lambda c: communities.hierarchy(_point_links(c), [0.5, 1.0, 2.0]))
add("fine_partition_select", lambda c: communities.partition_gate(communities.hierarchy(_point_links(c), [0.5, 1.0, 2.0]), c.points.count()))
add("spherical_seed", lambda c: layout.spherical_seed(c.points, 1000.0))
add("fr_layout_3d", lambda c: layout.layout(c.points.select("id", "val"), _point_links(c), "spring"))
add("force_atlas_world", lambda c: layout.layout(c.points.select("id", "val"), _point_links(c), "world"))
add("spectral_positions", lambda c: layout.spectral(_affinity(c), _groups(c)))

# --- exports
add(
    "export_csv",
    lambda c: exports.csv_rows(c.points.select("id", "name", "val", "type"), _chain(c)),
    f"SELECT 'node' AS data_type, id, name, val, type, NULL AS source, NULL AS target FROM points UNION ALL SELECT 'link', NULL, NULL, "
    f"NULL, NULL, source, target FROM {_CHAIN}",
)
add(
    "ndjson_stream",
    lambda c: exports.ndjson_rows(c.points.select("id", "name", "val", "type"), _chain(c)),
    "SELECT 'node' AS kind, '{\"kind\":\"node\",\"id\":\"' || id || '\",\"name\":\"' || name || '\",\"val\":\"' || val || "
    "'\",\"type\":\"' || type || '\"}' AS line FROM points UNION ALL SELECT 'link', '{\"kind\":\"link\",\"source\":\"' || source || "
    "'\",\"target\":\"' || target || '\"}' FROM " + _CHAIN +
    " UNION ALL SELECT 'meta', '{\"kind\":\"meta\",\"nodes\":' || (SELECT count(*) FROM points) || ',\"links\":' || (SELECT count(*) "
    "FROM " + _CHAIN + ") || '}'",
)
add(
    "export_json",
    lambda c: exports.graph_json(c.points.select("id", "name", "val", "type"), _chain(c)),
    "SELECT '{\"nodes\":[' || n || '],\"links\":[' || coalesce(l, '') || ']}' AS document FROM (SELECT string_agg('{\"id\":\"' || id "
    "|| '\",\"name\":\"' || name || '\",\"val\":\"' || val || '\",\"type\":\"' || type || '\"}', ',' ORDER BY id) AS n FROM points), "
    "(SELECT string_agg('{\"source\":\"' || source || '\",\"target\":\"' || target || '\"}', ',' ORDER BY source, target) AS l FROM " + _CHAIN
    + ")",
)

# --- incremental and streaming


def _refreshed(c: Corpus, which: int) -> DataFrame:
    """A state without the last years of some users, refreshed with the log of those users."""
    dirty = c.users.where("id % 7 = 0").select(F.col("id").alias("user_id"))
    held = (F.col("author_id") % 7 != 0) | (F.col("created_at") < F.lit("1996-01-01").cast("timestamp"))
    old = relational.activity(c.posts.where(held), c.comments.where(held))
    return incremental.refreshed(old, relational.overlap_pairs(old), c.posts, c.comments, dirty)[which]


add("incremental_activity_refresh", lambda c: _refreshed(c, 0), "SELECT * FROM active")
add("incremental_overlap_refresh", lambda c: _refreshed(c, 1), "SELECT * FROM pairs")
add(
    "windowed_counts",
    lambda c: incremental.windowed_counts(c.events, "1 hour", "30 minutes").select("start", "event_type", "n", _r("total", 3)),
    "SELECT CAST(s AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM (SELECT "
    "unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS s, event_type, value "
    "FROM events) GROUP BY 1, 2",
)
add(
    "backlog_limit",
    lambda c: incremental.started_within(c.events, "2024-01-15 12:00:00", 60, 100),
    "SELECT count(*) AS started, count(*) < 100 AS may_start FROM events WHERE ts > TIMESTAMP '2024-01-15 11:00:00' AND ts <= "
    "TIMESTAMP '2024-01-15 12:00:00'",
)
add(
    "crawl_request_upsert",
    lambda c: incremental.merged_requests(c.events.select(F.col("user_id").alias("target"), F.col("value")
    .alias("priority"), F.col("ts").alias("due_at"))),
    "SELECT user_id AS target, max(value) AS priority, min(ts) AS due_at FROM events GROUP BY 1",
)
add(
    "discovery_scoring",
    lambda c: incremental.discoveries(c.events.select(F.col("user_id").alias("target"), F.col("event_id")
    .alias("score"), (F.col("event_id") % 97 == 0).alias("mention")), 40),
    "SELECT user_id AS target, CAST(sum(event_id) AS BIGINT) AS score, max(CAST(event_id % 97 = 0 AS INTEGER)) AS mention FROM events "
    "GROUP BY 1 ORDER BY mention DESC, score DESC, target LIMIT 40",
)
add(
    "priority_aging",
    lambda c: incremental.aged(c.events.select("event_id", (F.col("event_id") % 90).alias("priority"), F.col("ts")
    .alias("created_at")), "2024-02-01").select("event_id", "priority"),
    "SELECT event_id, least(event_id % 90 + CAST(floor((epoch(TIMESTAMP '2024-02-01') - floor(epoch(ts))) / 86400) AS BIGINT), 100) AS "
    "priority FROM events",
)

# --- bounded reads


def _hidden(c: Corpus) -> DataFrame:
    """Suppressions of typed ids: every seventh post, some of them restored."""
    return c.posts.where("id % 7 = 0").select(C.typed_id("post", "id").alias("entity_id"), F.when(F.col("id") % 2 == 0, F.lit("2024-01-01")
        .cast("timestamp")).alias("restored_at"))


_HIDDEN = "(SELECT 'post_' || id FROM posts WHERE id % 7 = 0 AND id % 2 <> 0)"
add(
    "community_subgraph",
    lambda c: scopes.community_subgraph(c.points.select("id", "name", "val", "type"), _chain(c), c.points.where("community_id = 2"), 30),
    f"SELECT * FROM (WITH m AS (SELECT * FROM points WHERE community_id = 2) SELECT data_type, id, name, val, type, source, target FROM "
    f"(SELECT 'node' AS data_type, id, name, val, type, NULL AS source, NULL AS target FROM m UNION ALL SELECT 'link', source || '->' "
    f"|| target, NULL, NULL, NULL, source, target FROM {_CHAIN} WHERE source IN (SELECT id FROM m) AND target IN (SELECT id FROM m)) "
    f"ORDER BY data_type, id LIMIT 30)",
)
add(
    "communities_page",
    lambda c: scopes.communities_page(_landmarks(c).select("id", "size"), 5, 2),
    "SELECT id, size, (SELECT count(*) FROM landmarks) AS total FROM landmarks ORDER BY size DESC, id LIMIT 5 OFFSET 2",
)
add(
    "overview",
    lambda c: scopes.overview(_landmarks(c).select("id", F.col("id").alias("overview_rank")), spatial.bundle_weights(_chain(c), c.points)
    .withColumn("affinity", F.col("weight") / 10.0), 6, 8),
    f"SELECT 'node' AS data_type, CAST(id AS VARCHAR) AS id FROM (SELECT id FROM landmarks ORDER BY id LIMIT 6) UNION ALL SELECT * FROM "
    f"(SELECT 'link', source || '->' || target FROM ({_BW}) WHERE source IN (SELECT id FROM landmarks ORDER BY id LIMIT 6) AND target "
    f"IN (SELECT id FROM landmarks ORDER BY id LIMIT 6) ORDER BY weight DESC, source, target LIMIT 8)",
)
add(
    "community_scene",
    lambda c: scopes.community_scene(_entities(c), _hidden(c), "community_3", ["user", "post"], 100),
    f"SELECT id, label, type, value FROM ents WHERE community_id = 'community_3' AND type IN ('user', 'post') AND id NOT IN {_HIDDEN} "
    f"ORDER BY value DESC, id LIMIT 100",
)
add(
    "entity_system",
    lambda c: scopes.entity_system(_entities(c), "community_3", 20),
    "SELECT * FROM (WITH p AS (SELECT id, author_id FROM ents WHERE community_id = 'community_3' AND type = 'post' ORDER BY value "
    "DESC, id LIMIT 20) SELECT id, type, value FROM ents WHERE id IN (SELECT id FROM p) OR id IN (SELECT author_id FROM p))",
)
add(
    "lateral_unnest_refs",
    lambda c: scopes.references(_entities(c), "comment_5_2"),
    "SELECT id, type FROM ents WHERE id IN (SELECT unnest([parent_id, author_id, community_id]) FROM ents WHERE id = 'comment_5_2')",
)
add(
    "node_details",
    lambda c: scopes.node_details(c.nodes.select("id", F.col("name").alias("label")), c.links, "user_7", 10),
    "SELECT d.id, degree, name AS label, (SELECT degree FROM degree WHERE id = 'user_7') AS entity_degree FROM degree d JOIN nodes n "
    "ON d.id = n.id WHERE d.id IN (SELECT target FROM links WHERE source = 'user_7' UNION SELECT source FROM links WHERE target = "
    "'user_7') ORDER BY degree DESC, d.id LIMIT 10",
)
add(
    "entity_page",
    lambda c: scopes.entity_pages(_docs(c)),
    "SELECT id, CASE WHEN NOT sensitive THEN title END AS heading, CASE WHEN NOT sensitive THEN left(regexp_replace(body, '\\s+', ' ', "
    "'g'), 320) END AS summary FROM docs",
)
add(
    "sensitivity_flags",
    lambda c: scopes.sensitivity(_docs(c).select("id", F.col("sensitive").alias("source_sensitive"), (F.col("id") % 5 == 0)
    .alias("administrative_sensitive"))),
    "SELECT id, sensitive OR id % 5 = 0 AS sensitive, concat_ws(',', CASE WHEN sensitive THEN 'source' END, CASE WHEN id % 5 = 0 THEN "
    "'administrative' END) AS sources FROM docs",
)
add(
    "telemetry_totals",
    lambda c: scopes.telemetry(_entities(c), catalog.structural_links(_entities(c)), _hidden(c)),
    f"SELECT count(*) AS entities, count(*) FILTER (WHERE type = 'community') AS n_community, count(*) FILTER (WHERE type = 'user') AS "
    f"n_user, count(*) FILTER (WHERE type = 'post') AS n_post, count(*) FILTER (WHERE type = 'comment') AS n_comment, (SELECT count(*) "
    f"FROM structural WHERE source NOT IN {_HIDDEN} AND target NOT IN {_HIDDEN}) AS links FROM ents WHERE id NOT IN {_HIDDEN}",
)
add(
    "sitemap_tiers",
    lambda c: scopes.sitemap_tiers(_entities(c), _hidden(c), 500),
    f"SELECT e.id, CASE WHEN type = 'community' THEN 1 WHEN t.id IS NOT NULL THEN 2 ELSE 3 END AS tier FROM ents e LEFT JOIN (SELECT id "
    f"FROM ents WHERE type IN ('user', 'post') AND id NOT IN {_HIDDEN} ORDER BY value DESC, id LIMIT 500) t ON e.id = t.id WHERE e.id "
    f"NOT IN {_HIDDEN}",
)


def _levels(c: Corpus) -> DataFrame:
    """Two levels of communities over the points, in long format."""
    level = F.explode(F.array(F.struct(F.lit(1).alias("level"), F.col("community_id").alias("community_id")), F.struct(F.lit(2)
        .alias("level"), (F.col("community_id") % 3).alias("community_id"))))
    return c.points.select("id", level.alias("l")).select("id", "l.*")


_LEVELS = "(SELECT id, 1 AS level, community_id FROM points UNION ALL SELECT id, 2, community_id % 3 FROM points)"
add(
    "communities_at_level",
    lambda c: scopes.level_summary(_levels(c), c.points.select("id", *spatial.AXES), 2).select("community_id", "size", _r("pos_x"), _r(
    "pos_y"), _r("pos_z")),
    "SELECT community_id % 3 AS community_id, count(*) AS size, round(avg(pos_x), 6) AS pos_x, round(avg(pos_y), 6) AS pos_y, "
    "round(avg(pos_z), 6) AS pos_z FROM points GROUP BY 1",
)
add("distinct_levels", lambda c: _levels(c).select("level").distinct(), f"SELECT DISTINCT level FROM {_LEVELS}")
add("nodes_at_level", lambda c: _levels(c).where("level = 1").select("id", "community_id"), f"SELECT id, community_id FROM {_LEVELS} WHERE level = 1")
add(
    "manifest",
    lambda c: scopes.manifest(c.posts.agg(F.max("id").alias("revision_id")), _levels(c), catalog.quantiles(_entities(c))),
    f"SELECT (SELECT max(id) FROM posts) AS revision_id, (SELECT string_agg(CAST(level AS VARCHAR), ',' ORDER BY level) FROM (SELECT "
    f"DISTINCT level FROM {_LEVELS})) AS levels, '{{' || string_agg('\"' || type || '\":{{\"low\":' || lo || ',\"high\":' || hi || "
    f"'}}', ',' ORDER BY type) || '}}' AS quantiles FROM (SELECT type, quantile_disc(value, 0.05) AS lo, quantile_disc(value, 0.95) AS "
    f"hi FROM ents GROUP BY 1)",
)
add("bundles_min_weight", lambda c: spatial.bundle_weights(_chain(c), c.points).where("weight >= 5"), f"SELECT * FROM ({_BW}) WHERE weight >= 5")
add(
    "revision_bundles",
    lambda c: spatial.bundles(spatial.bundle_weights(_chain(c), c.points), spatial.centroids(c.points), 0.0)
    .select("source", "target", _r("control_x", 5), _r("control_y", 5), _r("control_z", 5)),
    f"SELECT * FROM (WITH w AS ({_BW}), k AS (SELECT community_id, avg(pos_x) AS x, avg(pos_y) AS y, avg(pos_z) AS z FROM points GROUP "
    f"BY 1) SELECT w.source, w.target, round((a.x + b.x) / 2, 5) AS control_x, round((a.y + b.y) / 2, 5) AS control_y, round((a.z + "
    f"b.z) / 2, 5) AS control_z FROM w JOIN k a ON a.community_id = w.source JOIN k b ON b.community_id = w.target)",
)
add(
    "comments_by_post",
    lambda c: c.comments.where("post_id = 5").select("id", "depth", "created_at").orderBy("created_at", "id"),
    "SELECT id, depth, created_at FROM comments WHERE post_id = 5",
)
add(
    "community_members_page",
    lambda c: ranking.offset_page(c.activity.where("community_id = 3").select("user_id"), ["user_id"], 40, 10),
    "SELECT user_id FROM active WHERE community_id = 3 ORDER BY user_id LIMIT 40 OFFSET 10",
)
add(
    "current_version",
    lambda c: c.table("orders").where("o_orderstatus = 'F'").agg(F.max("o_orderkey").alias("id")),
    "SELECT max(o_orderkey) AS id FROM orders WHERE o_orderstatus = 'F'",
)


def _versions(c: Corpus) -> DataFrame:
    return c.table("orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "completed")
        .otherwise("running").alias("status"))


add(
    "diffs_since",
    lambda c: scopes.diffs_since(c.lines.select(F.col("l_orderkey").alias("version_id"), F.col("l_returnflag")
    .alias("action")), _versions(c), 100),
    "SELECT l_orderkey AS version_id, l_returnflag AS action, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE "
    "o_orderstatus = 'F' AND o_orderkey > 100 GROUP BY 1, 2",
)
add(
    "jobs_with_names",
    lambda c: c.events.select("event_id", (F.col("user_id") % 10 + 1).alias("id")).join(c.communities.select("id", "name"), "id")
    .select("event_id", "name"),
    "SELECT event_id, name FROM events JOIN communities ON id = user_id % 10 + 1",
)
add(
    "resolve_reference_target",
    lambda c: c.posts.select(F.col("id").alias("post_id"), F.concat(F.lit("SUPPLIER#"), F.lpad((F.col("id") % 20)
    .cast("string"), 9, "0")).alias("ref")).join(c.communities.select(F.col("id").alias("target_id"), F.lower("name")
    .alias("_n")), F.lower("ref") == F.col("_n"), "left").select("post_id", "target_id"),
    "SELECT p.id AS post_id, c.id AS target_id FROM posts p LEFT JOIN communities c ON lower('SUPPLIER#' || lpad(CAST(p.id % 20 AS "
    "VARCHAR), 9, '0')) = lower(c.name)",
)
add(
    "enqueue_if_absent",
    lambda c: c.users.select("id").join(c.events.select(F.col("user_id").alias("id")), "id", "left_anti"),
    "SELECT id FROM users WHERE id NOT IN (SELECT user_id FROM events)",
)
add(
    "touch_community",
    lambda c: c.communities.select("id", F.when(F.col("name") == "Supplier#000000003", F.lit("2024-06-01")
    .cast("timestamp")).alias("last_seen")),
    "SELECT id, CASE WHEN name = 'Supplier#000000003' THEN TIMESTAMP '2024-06-01' END AS last_seen FROM communities",
)
add(
    "representative_members",
    lambda c: scopes.representative_members(c.communities.select(F.col("nation").alias("group_id"), "id", "name", F.col("subscribers")
    .cast("double").alias("strength")), c.communities.where("id % 4 = 0").select("name"), 3).select("group_id", "id", _r("score")),
    "SELECT group_id, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY score DESC, id) "
    "AS k FROM (SELECT nation AS group_id, id, (0.4 * subscribers / greatest(max(subscribers) OVER (PARTITION BY nation), 1e-12) + "
    "0.15 + 0.14 + 0.1 * CASE WHEN id % 4 = 0 THEN 0.0 ELSE 1.0 END) * CASE WHEN id % 4 = 0 THEN 0.5 ELSE 1.0 END AS score FROM "
    "communities)) WHERE k <= 3",
)


add(
    "label_cache",
    lambda c: scopes.cached_labels(c.communities.select(F.col("id").alias("group_id"), F.col("name").alias("label"), F.sha2("name", 256)
    .alias("fingerprint")), c.communities.where("id % 3 = 0").select(F.sha2("name", 256).alias("fingerprint"), F.lit("cached")
    .alias("label"))),
    "SELECT id AS group_id, CASE WHEN id % 3 = 0 THEN 'cached' ELSE name END AS label, id % 3 = 0 AS hit FROM communities",
)
add(
    "landmark_coverage",
    lambda c: _landmarks(c).groupBy("macro_id").agg(F.sum("size").alias("held")).agg(F.min("held").alias("least"), F.count("*")
    .alias("n_groups")).select("least", "n_groups", (F.col("least") >= 5).alias("passed")),
    "SELECT CAST(min(held) AS BIGINT) AS least, count(*) AS n_groups, min(held) >= 5 AS passed FROM (SELECT macro_id, sum(size) AS "
    "held FROM landmarks GROUP BY 1)",
)
add("shell_position", lambda c: layout.shell_positions(c.points, 100.0))
