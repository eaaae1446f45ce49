"""Queries of workspace changes, explorer reads, life cycles and whole builds, beside SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithgraph.functions import columns as C
from kithgraph.functions import cursors
from kithgraph.operators import affinity, client, communities, explore, integrity, layout, octree, ranking, relational, scopes, search, spatial
from kithgraph.plans import catalog, publish, revisions
from kithgraph.plans.queries import _affinity, _chain, _docs, _entities, _groups, _hidden, _landmarks, _point_links, _suppressed
from kithgraph.plans.registry import add, query
from kithgraph.plans.serve import Explorer
from kithgraph.plans.staging import shared_dir, staged
from kithgraph.sources import exports, workspace
from kithgraph.sources.corpus import Corpus
from kithgraph.streaming import incremental, lifecycle

NOW = "1998-08-01 00:00:00"


def _space(c: Corpus) -> workspace.Workspace:
    """A workspace of its own in the shared folder."""
    return workspace.Workspace(c.spark, f"{shared_dir(c.spark)}/space-{uuid.uuid4().hex}")


def _store(c: Corpus) -> publish.Store:
    return publish.Store(c.spark, f"{shared_dir(c.spark)}/store-{uuid.uuid4().hex}")


# --- sources and sinks
add(
    "scan_settings",
    lambda c: c.table("nation").select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string")
    .alias("value")),
    "SELECT n_name AS key, CAST(n_regionkey AS VARCHAR) AS value FROM nation",
)
add("copy_in_sink", lambda c: staged(c.users, "copied"), "SELECT * FROM users")


def _replies(c: Corpus) -> DataFrame:
    """Comments as nested JSON: each with a removed reply, which has a deleted one."""
    inner = F.struct(F.concat("id", F.lit("/2")).alias("id"), F.lit("[deleted]").alias("body"))
    reply = F.struct(F.concat("id", F.lit("/1")).alias("id"), F.lit("[removed]").alias("body"), F.array(inner).alias("replies"))
    return c.comments.select(F.to_json(F.struct("id", "body", F.array(reply).alias("replies"))).alias("raw"))


add(
    "comment_tree_flatten",
    lambda c: exports.flattened(_replies(c), 2),
    """SELECT id, NULL AS parent_id, 0 AS depth, body, false AS removed, false AS deleted FROM comments
    UNION ALL SELECT id || '/1', id, 1, '[removed]', true, false FROM comments
    UNION ALL SELECT id || '/2', id || '/1', 2, '[deleted]', false, true FROM comments""",
)


@query(
    "embedded_text_source",
    "SELECT lower(trim(r_name)) AS name, (SELECT sha256(string_agg(r_name, chr(10) ORDER BY r_name) || chr(10)) FROM region) AS sha256 FROM region",
)
def _embedded(c: Corpus) -> DataFrame:
    path = f"{shared_dir(c.spark)}/names-{uuid.uuid4().hex}"
    c.table("region").select("r_name").orderBy("r_name").coalesce(1).write.text(path)
    return exports.name_list(c.spark, path)


@query("upsert_communities",
    "SELECT id, CASE WHEN id % 3 = 0 THEN 'renamed' ELSE name END AS name, CASE WHEN id % 3 = 0 THEN 7 ELSE subscribers END AS "
    "subscribers, nation FROM communities UNION ALL SELECT 1000000, 'renamed', 7, 0")
def _upserted_communities(c: Corpus) -> DataFrame:
    space, rows = _space(c), c.communities
    space.replace("communities", rows)
    new = rows.where("id % 3 = 0").withColumns({"name": F.lit("renamed"), "subscribers": F.lit(7)})
    space.upsert("communities", new.unionByName(rows.limit(1).select(F.lit(1_000_000).cast(rows.schema["id"].dataType)
        .alias("id"), F.lit("renamed").alias("name"), F.lit(7).alias("subscribers"), F.lit(0).cast(rows.schema["nation"].dataType)
        .alias("nation"))), ["id"])
    return space.read("communities")


@query("upsert_users_keeps_the_last", "SELECT id, CASE WHEN id % 5 = 0 THEN username || ' 2' ELSE username END AS username FROM users")
def _upserted_users(c: Corpus) -> DataFrame:
    space = _space(c)
    space.replace("users", c.users)
    twice = c.users.where("id % 5 = 0").withColumn("n", F.explode(F.array(F.lit(1), F.lit(2))))
    last = workspace.last_by_key(twice, ["id"], F.col("n"))
    space.upsert("users", last.select("id", F.concat("username", F.lit(" "), F.col("n").cast("string")).alias("username")), ["id"])
    return space.read("users")


@query("upsert_posts_touches_changes",
    f"SELECT id, CASE WHEN id % 4 = 0 THEN score + 1 ELSE score END AS score, CASE WHEN id % 4 = 0 THEN TIMESTAMP '{NOW}' ELSE "
    f"created_at END AS updated_at FROM posts")
def _upserted_posts(c: Corpus) -> DataFrame:
    space = _space(c)
    rows = c.posts.select("id", "score", F.col("created_at").cast("timestamp").alias("updated_at"))
    space.replace("posts", rows)
    space.upsert("posts", rows.where("id % 2 = 0").select("id", (F.col("score") + F.when(F.col("id") % 4 == 0, 1)
        .otherwise(0)).alias("score")), ["id"], touch="updated_at", now=NOW)
    return space.read("posts")


@query("upsert_comments", "SELECT id, post_id, CASE WHEN depth = 0 THEN '[removed]' ELSE body END AS body FROM comments")
def _upserted_comments(c: Corpus) -> DataFrame:
    space = _space(c)
    rows = c.comments.select("id", "post_id", "body")
    space.replace("comments", rows)
    space.upsert("comments", c.comments.where("depth = 0").select("id", "post_id", F.lit("[removed]").alias("body")), ["id"])
    return space.read("comments")


@query("ensure_community", "SELECT id, name FROM communities UNION ALL SELECT -1, 'new one'")
def _ensured(c: Corpus) -> DataFrame:
    space = _space(c)
    rows = c.communities.select("id", "name")
    space.replace("communities", rows)
    asked = rows.where("id < 5").unionByName(rows.limit(1).select(F.lit(-1).cast(rows.schema["id"].dataType)
        .alias("id"), F.lit("new one").alias("name")))
    space.insert("communities", asked, ["name"])
    return space.read("communities")


@query("upsert_setting", "SELECT n_name AS key, CASE WHEN n_regionkey = 1 THEN 'changed' ELSE CAST(n_regionkey AS VARCHAR) END AS value FROM nation")
def _settings(c: Corpus) -> DataFrame:
    space = _space(c)
    rows = c.table("nation").select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value"))
    space.replace("settings", rows)
    space.upsert("settings", rows.where("value = '1'").withColumn("value", F.lit("changed")), ["key"])
    return space.read("settings")


@query("upsert_relationship",
    "SELECT source, target, CASE WHEN source < target THEN overlap_count + 1 ELSE overlap_count END AS overlap_count FROM relationships")
def _relationships(c: Corpus) -> DataFrame:
    space, rows = _space(c), staged(c.relationships, "relationships")
    space.replace("relationships", rows)
    space.upsert("relationships", rows.where("source < target").withColumn("overlap_count", F.col("overlap_count") + 1), ["source", "target"])
    return space.read("relationships")


@query("insert_activity_and_links", "SELECT user_id, community_id, activity_count FROM active")
def _inserted(c: Corpus) -> DataFrame:
    """In three overlapping batches, of which each adds only what is not there."""
    space, rows = _space(c), staged(c.activity, "activity")
    for batch in ("user_id % 3 < 2", "user_id % 3 > 0", "user_id % 3 <> 1"):
        space.insert("activity", rows.where(batch), ["user_id", "community_id"])
    return space.read("activity")


@query("truncate_workspace", "SELECT 0 AS before, count(*) AS after FROM users")
def _truncated(c: Corpus) -> DataFrame:
    space = _space(c)
    space.replace("users", c.users)
    space.truncate("users")
    before = space.read("users").agg(F.count("*").cast("int").alias("before")).first()["before"]
    space.append("users", c.users)
    return space.read("users").agg(F.lit(before).alias("before"), F.count("*").alias("after"))


@query("delete_by_keys", "SELECT id, username FROM users WHERE id % 2 = 1")
def _deleted(c: Corpus) -> DataFrame:
    space = _space(c)
    space.replace("users", c.users)
    space.delete("users", c.users.where("id % 2 = 0").select("id"))
    return space.read("users")


@query(
    "suppress_restore_audit",
    """SELECT 'suppressed' AS kind, 'post_1' AS id, 'spam' AS note UNION ALL SELECT 'restored', 'post_2', 'spam'
    UNION ALL SELECT 'audit', 'post_1', 'suppress_public_entity' UNION ALL SELECT 'audit', 'post_2', 'suppress_public_entity' UNION ALL SELECT 'audit', 'post_2', 'restore_public_entity'""",
)
def _suppressions(c: Corpus) -> DataFrame:
    space = _space(c)
    for k in (1, 2):
        workspace.suppress(space, f"post_{k}", "post", "spam", "operator", NOW)
    workspace.restore(space, "post_2", "operator", NOW)
    s = space.read("suppressions").select(F.when(F.col("restored_at").isNull(), "suppressed").otherwise("restored")
        .alias("kind"), F.col("entity_id").alias("id"), F.col("reason").alias("note"))
    return s.unionByName(space.read("audit").select(F.lit("audit").alias("kind"), F.col("resource_id").alias("id"), F.col("action").alias("note")))


# --- changes and checks


def _seen(c: Corpus) -> tuple[DataFrame, DataFrame]:
    """Communities and users with the time of their last post."""
    by = [c.posts.groupBy(F.col(k).alias("id")).agg(F.max("created_at").alias("last_seen")) for k in ("community_id", "author_id")]
    return c.communities.select("id").join(by[0], "id"), c.users.select("id").join(by[1], "id")


_SEEN = {k: f"(SELECT {k} AS id, max(created_at) AS last_seen FROM posts GROUP BY 1)" for k in ("community_id", "author_id")}
add(
    "stale_entities",
    lambda c: relational.stale(dict(zip(("community", "user"), _seen(c), strict=True)), NOW, 30),
    " UNION ALL ".join(
        f"SELECT '{t}' AS type, CAST(id AS VARCHAR) AS id, CAST(trunc((epoch(TIMESTAMP '{NOW}') - epoch(last_seen)) / 86400) AS "
        f"INTEGER) AS days FROM {_SEEN[k]} WHERE last_seen < TIMESTAMP '{NOW}' - INTERVAL 30 DAY" for t, k in (("community", "community_id"),
        ("user", "author_id"))),
)


@query(
    "changed_entity_counts_all",
    f"SELECT (SELECT count(*) FROM {_SEEN['community_id']} WHERE last_seen > TIMESTAMP '1997-01-01') AS communities, (SELECT count(*) "
    f"FROM {_SEEN['author_id']} WHERE last_seen > TIMESTAMP '1997-01-01') AS users, (SELECT count(*) FROM posts WHERE created_at > "
    f"TIMESTAMP '1997-01-01') AS posts, (SELECT count(*) FROM comments WHERE created_at > TIMESTAMP '1997-01-01') AS comments",
)
def _changed_counts(c: Corpus) -> DataFrame:
    a, b = _seen(c)
    out = None
    for name, rows, at in (("communities", a, "last_seen"), ("users", b, "last_seen"), ("posts", c.posts, "created_at"), ("comments", c.comments,
        "created_at")):
        n = relational.changed_since(rows, "1997-01-01", (at,)).agg(F.count("*").alias(name))
        out = n if out is None else out.crossJoin(n)  # one-row frames
    return out


add(
    "affected_communities",
    lambda c: relational.changed_since(c.posts, "1998-01-01").select("community_id").union(relational.changed_since(c.comments, "1998-01-01")
        .select("community_id")).distinct(),
    "SELECT community_id FROM posts WHERE created_at > TIMESTAMP '1998-01-01' UNION SELECT community_id FROM comments WHERE created_at "
    "> TIMESTAMP '1998-01-01'",
)


@query(
    "orphan_deletes_in_batches",
    """SELECT 'posts' AS kind, (SELECT count(*) FROM all_posts WHERE community_id IS NULL) AS gone, (SELECT count(*) FROM posts) AS left_over
    UNION ALL SELECT 'comments', (SELECT count(*) FROM comments WHERE post_id % 10 = 0), (SELECT count(*) FROM comments WHERE post_id % 10 <> 0)
    UNION ALL SELECT 'links', (SELECT count(*) FROM links WHERE source LIKE 'user%'), (SELECT count(*) FROM links WHERE source NOT LIKE 'user%')
    UNION ALL SELECT 'nodes', (SELECT count(*) FROM nodes WHERE id NOT IN (SELECT id FROM degree)), (SELECT count(*) FROM nodes WHERE id IN (SELECT id FROM degree))""",
)
def _orphan_deletes(c: Corpus) -> DataFrame:
    """Batch after batch until none is left."""
    out = None
    posts = staged(c.all_posts.select("id", "author_id", "community_id"), "posts")
    comments = staged(c.comments.select("id", "post_id", "author_id"), "comments")
    links, nodes = staged(c.links, "links"), staged(c.nodes, "nodes")
    known = posts.where("community_id is not null and id % 10 <> 0")
    checks = {
        "posts": (posts.select("id"), integrity.orphan_posts(posts, c.communities, c.users), ["id"]),
        "comments": (comments.select("id"), integrity.orphan_comments(comments, known, c.users), ["id"]),
        "links": (links, integrity.orphan_links(links, nodes.where("type <> 'user'")), ["source", "target"]),
        "nodes": (nodes.select("id"), integrity.orphan_nodes(nodes, links).select("id"), ["id"]),
    }
    for kind, (rows, orphans, keys) in checks.items():
        orphans = staged(orphans, "orphans")
        gone, batch = 0, max(1, rows.count() // 2)
        while True:
            taken, rest = integrity.deleted_in_batches(rows, orphans, keys, batch)
            n = taken.count()
            gone += n
            if n < batch:  # all that were left
                rows = rest
                break
            rows = staged(rest, "batch")
        row = rows.agg(F.lit(kind).alias("kind"), F.lit(gone).cast("long").alias("gone"), F.count("*").alias("left_over"))
        out = row if out is None else out.unionByName(row)
    return out


add(
    "snapshot_diff_links",
    lambda c: integrity.full_diff((c.points.where("community_id <> 0"), _chain(c).where("source <> 'point_3'")), (c.points.where(
        "community_id <> 1"), _chain(c).where("target <> 'point_9'"))),
    "SELECT 'node' AS entity_type, CASE community_id WHEN 0 THEN 'add' ELSE 'remove' END AS action, id FROM points WHERE community_id "
    "IN (0, 1) UNION ALL SELECT 'link', 'add', 'point_3->point_4' UNION ALL SELECT 'link', 'remove', 'point_8->point_9'",
)


@query("first_snapshot_diff",
    "SELECT 'node' AS entity_type, 'add' AS action, count(*) AS n FROM points UNION ALL SELECT 'link', 'add', count(*) - 1 FROM points")
def _first_diff(c: Corpus) -> DataFrame:
    return integrity.full_diff(None, (c.points, _chain(c))).groupBy("entity_type", "action").agg(F.count("*").alias("n"))


add(
    "dirty_log_capture",
    lambda c: incremental.dirty_users(c.posts.where("id % 5 <> 0"), c.posts.where("id % 7 <> 0").withColumn("community_id", F.when(F.col(
        "id") % 11 == 0, F.col("community_id") + 1).otherwise(F.col("community_id")))),
    "SELECT DISTINCT author_id AS user_id FROM posts WHERE (id % 5 = 0 AND id % 7 <> 0) OR (id % 5 <> 0 AND id % 7 = 0) OR (id % 5 <> "
    "0 AND id % 7 <> 0 AND id % 11 = 0)",
)
add(
    "dirty_log_of_a_truncation",
    lambda c: incremental.dirty_users(c.posts, c.posts.limit(0)),
    "SELECT DISTINCT author_id AS user_id FROM posts UNION ALL SELECT NULL",
)


@query("mode_select",
    "SELECT 'few' AS changed, 'incremental' AS mode UNION ALL SELECT 'many', 'full' UNION ALL SELECT 'none known', 'full' UNION ALL "
    "SELECT 'truncated', 'full'")
def _modes(c: Corpus) -> DataFrame:
    n = c.users.count()
    ids = c.users.select(F.col("id").alias("user_id"))
    few, many = ids.where("user_id = 1"), ids.where("user_id % 2 = 0")
    found = [("few", incremental.mode(n, few, True)), ("many", incremental.mode(n, many, True)), ("none known", incremental.mode(n, few,
        False)), ("truncated", incremental.mode(n, few.unionByName(ids.limit(1).select(F.lit(None).cast(ids.schema[0].dataType)
        .alias("user_id"))), True))]
    return c.spark.createDataFrame(found, "changed string, mode string")


add(
    "once_within_the_watermark",
    lambda c: incremental.once(c.events.unionByName(c.events.where("event_id % 3 = 0"))).select("event_id"),
    "SELECT event_id FROM events",
)
add("session_windows", lambda c: incremental.session_counts(c.events, "30 minutes").select("user_id", "start", "end", "n"), """
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM (
      SELECT user_id, ts, sum(CASE WHEN last IS NULL OR ts - last >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s
      FROM (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last FROM events)
    ) GROUP BY user_id, s""")  # fmt: skip
add(
    "tumbling_windows",
    lambda c: incremental.tumbling_counts(c.events).select("start", "event_type", "n", F.round("total", 3)
    .alias("total")),
    "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY "
    "1, 2",
)
add(
    "rate_and_quantiles",
    lambda c: incremental.rate(c.events, width="1 hour", step="30 minutes").select("start", "event_type", F.round("per_second", 8)
        .alias("per_second"), "p50", "p95"),
    "SELECT CAST(s AS TIMESTAMP) AS start, event_type, round(count(*) / 3600.0, 8) AS per_second, quantile_disc(value, 0.5) AS p50, "
    "quantile_disc(value, 0.95) AS p95 FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - "
    "INTERVAL 30 MINUTE]) AS s, event_type, value FROM events) GROUP BY 1, 2",
)

# --- expressions
add(
    "mention_regex",
    lambda c: c.table("pages").select("page_id", F.array_join(F.array_sort(C.mentions(F.concat("html", F.lit(
        " /R/Alpha and /r/beta_2, /r/alpha /x/no")))), ",").alias("names")),
    "SELECT page_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(html || ' /R/Alpha and /r/beta_2, "
    "/r/alpha /x/no', '/r/([a-z0-9_]+)', 1, 'i'), lambda x: lower(x)))), ',') AS names FROM pages",
)


@query(
    "id_helpers",
    """SELECT id, CASE WHEN parent_id LIKE 't1_%' OR parent_id LIKE 't3_%' THEN substr(parent_id, 4) ELSE parent_id END AS bare, CAST(post_id AS VARCHAR) AS post, score % 2 = 0 AS known,
    least(author_id, community_id) AS u, greatest(author_id, community_id) AS v FROM comments""",
)
def _ids(c: Corpus) -> DataFrame:
    link = F.concat(F.lit("/r/x/comments/"), F.col("post_id").cast("string"), F.lit("/title/"), "id")
    author = F.when(F.col("score") % 2 == 0, "someone").when(F.col("score") % 3 == 0, "[deleted]").when(F.col("score") % 5 == 0, "").otherwise(
        F.lit(None))
    return c.comments.select("id", C.bare_id(F.col("parent_id")).alias("bare"), C.post_of_permalink(link)
        .alias("post"), C.known_author(author).alias("known"), *C.pair("author_id", "community_id"))


add(
    "url_escape",
    lambda c: c.communities.select("id", C.path_segment(F.concat("name", F.lit(" a/b?c=é&d+e"))).alias("segment")),
    "SELECT id, url_encode(name || ' a/b?c=é&d+e') AS segment FROM communities",
)
add(
    "retry_backoff_with_jitter",
    lambda c: c.events.select("event_id", C.retry_delay((F.col("event_id") % 15).cast("double"), F.col("event_id"))
        .alias("m")).select("event_id", F.col("m").between(F.least(F.pow(F.lit(2.0), F.col("event_id") % 15), F.lit(1440.0)), 1.2 * F.least(
        F.pow(F.lit(2.0), F.col("event_id") % 15), F.lit(1440.0))).alias("in_range")),
    "SELECT event_id, true AS in_range FROM events",
)
_COLOURS = (
    "(SELECT id, CASE id % 3 WHEN 0 THEN 104 WHEN 1 THEN 182 ELSE 255 END AS r, (id % 21 - 10) / 10.0 AS p, (id % 11) / 10.0 AS s FROM "
    "communities)")
add(
    "cluster_shade",
    lambda c: c.communities.select("id", C.shade(F.element_at(F.array(F.lit("#681010"), F.lit("#B61010"), F.lit("#FF1010")), (F.col("id") % 3
        + 1).cast("int")), (F.col("id") % 21 - 10) / 10.0, (F.col("id") % 11) / 10.0).alias("colour")).select("id", F.substring("colour", 1,
        3).alias("red")),
    f"SELECT id, '#' || upper(lpad(to_hex(CAST(floor(least(255.0, greatest(0.0, CASE WHEN p >= 0 THEN r * l + (255 - r * l) * p * 0.16 "
    f"ELSE r * l * (1 + p * 0.16) END)) + 0.5) AS BIGINT)), 2, '0')) AS red FROM (SELECT id, r, p, 0.72 + 0.28 * s AS l FROM {_COLOURS})",
)
add(
    "distinctiveness_confidence",
    lambda c: c.communities.select("id", F.round(C.distinctiveness(F.col("subscribers") / 1000.0), 6)
        .alias("distinctiveness"), F.round(C.confidence(F.col("id") % 40), 6).alias("confidence"), C.is_bridge((F.col("id") % 10) / 10.0, (F.col(
        "id") % 7) / 10.0).alias("is_bridge")),
    "SELECT id, round(least(1.0, (subscribers / 1000.0) / (1 + subscribers / 1000.0)), 6) AS distinctiveness, round(least(1.0, (id % "
    "40) / 20.0), 6) AS confidence, (id % 7) / 10.0 >= 0.3 AND (id % 10) / 10.0 > 0 AND (id % 7) / 10.0 >= 0.55 * ((id % 10) / 10.0) "
    "AS is_bridge FROM communities",
)
add(
    "link_opacity",
    lambda c: c.points.select("id", F.round(spatial.link_opacity(F.abs("pos_x") * 4000), 6).alias("opacity")),
    "SELECT id, round(CASE WHEN abs(pos_x) * 4000 < 600 THEN 0.6 ELSE greatest(0.1, least(0.8, 0.6 * greatest(0.0, 1 - (abs(pos_x) * "
    "4000 - 600) / 1200))) END, 6) AS opacity FROM points",
)

# --- the explorer's reads
_VISIBLE = "(SELECT * FROM ents WHERE id NOT IN (SELECT 'post_' || id FROM posts WHERE id % 7 = 0 AND id % 2 <> 0))"


def _weighted_links(c: Corpus) -> DataFrame:
    return catalog.structural_links(_entities(c)).select("source", "target", "relation", F.lit(True).alias("directed"), F.lit(1)
        .cast("long").alias("weight"))


add(
    "region_links",
    lambda c: spatial.region_links(_entities(c).where("community_id = 'community_3'"), c.relationships.select(C.typed_id("community",
        "source").alias("source"), C.typed_id("community", "target").alias("target"), F.lit("overlap")
        .alias("relation"), F.lit(False).alias("directed"), F.col("overlap_count").cast("long").alias("weight")), _entities(c), 300),
    """SELECT * FROM (WITH k AS (SELECT * FROM ents WHERE community_id = 'community_3'), m AS (
      SELECT author_id AS source, id AS target, 'authorship' AS relation, true AS directed, 1 AS weight FROM k
      UNION ALL SELECT id, parent_id, CASE WHEN type = 'post' THEN 'published_in' WHEN parent_id LIKE 'comment%' THEN 'reply' ELSE 'comment_on' END, true, 1 FROM k
    ) SELECT * FROM m WHERE source IN (SELECT id FROM k) AND target IN (SELECT id FROM k) ORDER BY weight DESC, source, target, relation LIMIT 300)""",
)
add(
    "keyset_page_links",
    lambda c: ranking.page_links(ranking.keyset_page(c.nodes, 100, None).limit(100), c.links, 100),
    "SELECT source, target FROM links WHERE source IN (SELECT id FROM weighted ORDER BY w DESC, id LIMIT 100) AND target IN (SELECT id "
    "FROM weighted ORDER BY w DESC, id LIMIT 100) ORDER BY source, target LIMIT 500",
)


@query("cursor_pages", "SELECT id FROM weighted ORDER BY w DESC, id LIMIT 150")
def _pages(c: Corpus) -> DataFrame:
    """Three pages of the graph, each from the cursor of the one before; together they are the first 150 nodes."""
    view = Explorer(staged(c.nodes, "nodes"), c.links)
    cursor, out = None, None
    for _ in range(3):
        page = staged(view.graph_page(50, cursor).limit(50), "page")
        last = page.select(C.weight().alias("w"), "id").orderBy("w", F.desc("id")).first()
        cursor = cursors.encode_keyset(last["w"], last["id"])
        out = page if out is None else out.unionByName(page)
    return out.select("id")


@query("signed_cursor", "SELECT true AS round_trip, true AS other_filter_refused, true AS other_revision_refused, true AS forged_refused")
def _cursors(c: Corpus) -> DataFrame:
    token = cursors.sign(b"secret", "r1", "c1", {"q": "x", "type": ""}, {"start": 50})

    def refused(secret: bytes, revision: str, filters: dict[str, object]) -> bool:
        try:
            cursors.verify(secret, token, revision, "c1", filters)
        except cursors.BadCursor:
            return True
        return False

    got = cursors.verify(b"secret", token, "r1", "c1", {"q": "x"}) == {"start": 50}
    return c.spark.createDataFrame([(got, refused(b"secret", "r1", {"q": "y"}), refused(b"secret", "r2", {"q": "x"}), refused(b"other", "r1",
        {"q": "x"}))], "round_trip boolean, other_filter_refused boolean, other_revision_refused boolean, forged_refused boolean")


@query("pinned_cursors",
    "SELECT 'region' AS kind, 40 AS start, true AS refused UNION ALL SELECT 'community', 40, true UNION ALL SELECT 'entity', 40, true")
def _pinned(c: Corpus) -> DataFrame:
    rows = []
    for kind, where in (("region", {"revision": 3, "catalog": 2}), ("community", {"revision": 3, "level": 1}), ("entity", {"revision": 3,
        "catalog": 2, "root": "post_1", "expand": "thread", "depth": 2})):
        token = cursors.pin(kind, 40, **where)
        refused = False
        try:
            cursors.pinned(kind, token, **(where | {"revision": 4}))
        except cursors.Moved:
            refused = True
        rows.append((kind, cursors.pinned(kind, token, **where), refused))
    return c.spark.createDataFrame(rows, "kind string, start int, refused boolean")


def _catalog_rows(c: Corpus) -> DataFrame:
    """Posts as entities with documents, sorts and filters."""
    return c.posts.select("id", "title", F.concat_ws(" ", F.lit("about"), "title").alias("description"), F.col("title")
        .alias("body"), F.col("score").alias("value"), (F.col("id") % 50).alias("activity"), (F.col("id") % 9 / 9.0)
        .alias("distinctiveness"), F.col("created_at").alias("updated_at"), F.col("community_id").cast("string")
        .alias("community_id"))


_CAT = {"activity": "id % 50 DESC", "size": "score DESC", "distinctiveness": "id % 9 DESC", "newest": "created_at DESC"}
for _name, _order in _CAT.items():
    add(
        f"catalog_by_{_name}",
        lambda c,
        s=_name: search.sorted_catalog(_catalog_rows(c), "", s, 60, 20, community_id="3").select("id"),
        f"SELECT id FROM posts WHERE community_id = 3 ORDER BY {_order}, score DESC, id LIMIT 60 OFFSET 20",
    )
add(
    "catalog_by_relevance_with_descriptions",
    lambda c: search.sorted_catalog(_catalog_rows(c), "urgent", None, 60).select("id", F.round("relevance", 6).alias("relevance")),
    "SELECT id, CAST(round(1.0 + 0.2 + 0.4 + CASE WHEN lower(title) = 'urgent' THEN 2.0 WHEN starts_with(lower(title), 'urgent') THEN "
    "1.0 ELSE 0.0 END, 6) AS DOUBLE) AS relevance FROM posts WHERE list_contains(regexp_split_to_array(lower(title), '[^a-z0-9]+'), "
    "'urgent') ORDER BY relevance DESC, score DESC, id LIMIT 60",
)
add(
    "entity_neighbourhood_with_references",
    lambda c: explore.neighbourhood(_entities(c), _weighted_links(c).where("relation = 'authorship'"), _hidden(c), "post_5", 40).select("id",
        "type", "value"),
    f"""SELECT id, type, value FROM {_VISIBLE} WHERE id IN (SELECT id FROM (
      SELECT 'post_5' AS id, 9223372036854775807 AS p UNION ALL SELECT n, 1 FROM (
        SELECT source AS n FROM structural WHERE target = 'post_5' AND relation = 'authorship' UNION SELECT unnest([parent_id, author_id]) FROM ents WHERE id = 'post_5' UNION SELECT id FROM ents WHERE parent_id = 'post_5' OR author_id = 'post_5')
      ) ORDER BY p DESC, id LIMIT 40)""",
)


def _clusters(c: Corpus) -> DataFrame:
    return _landmarks(c).select(C.typed_id("community", "id").alias("id"), F.concat(F.lit("Cluster "), F.col("id")
        .cast("string")).alias("label"), "size", F.concat(F.lit("m"), F.col("macro_id").cast("string"))
        .alias("macro_group_id"), "distinctiveness", "confidence")


def _papers(c: Corpus) -> DataFrame:
    return c.posts.select(C.typed_id("post", "id").alias("id"), "title", F.col("title").alias("body"), (F.col("id") % 3 == 0)
        .alias("source_sensitive"), (F.col("id") % 4 == 0).alias("administrative_sensitive"))


_DETAIL = """SELECT e.id, label AS name, value, type, e.community_id, macro AS macro_group_id, coalesce(distinctiveness, 0.0) AS distinctiveness, coalesce(confidence, 0.0) AS confidence,
  CASE WHEN p.id % 3 <> 0 AND p.id % 4 <> 0 THEN title END AS title, CASE WHEN p.id % 3 <> 0 AND p.id % 4 <> 0 THEN title END AS body, coalesce(p.id % 3 = 0 OR p.id % 4 = 0, false) AS sensitive, '/catalog/' || type || 's/' || e.id AS page
  FROM ents e LEFT JOIN posts p ON e.id = 'post_' || p.id LEFT JOIN (SELECT 'community_' || id AS cid, 'm' || macro_id AS macro, distinctiveness, confidence FROM landmarks) ON cid = e.community_id"""
add("entity_details", lambda c: explore.details(_entities(c), _papers(c), _clusters(c), _hidden(c), "post_5"), f"{_DETAIL} WHERE e.id = 'post_5'")
add(
    "entity_details_of_what_is_hidden",
    lambda c: explore.details(_entities(c), _papers(c), _clusters(c), _hidden(c), "post_7"),
    f"{_DETAIL} WHERE e.id = 'post_7' AND false",
)
add(
    "cluster_details",
    lambda c: explore.details(_entities(c).where("type = 'user'"), _papers(c), _clusters(c), _hidden(c), "community_3").select("id", "name",
        "value", "type", "macro_group_id"),
    "SELECT 'community_3' AS id, 'Cluster 3' AS name, CAST(size AS BIGINT) AS value, 'cluster' AS type, 'm' || macro_id AS "
    "macro_group_id FROM landmarks WHERE id = 3",
)
add(
    "close_entities",
    lambda c: explore.close_entities(_entities(c), _weighted_links(c), _hidden(c), "post_5", 20),
    f"""SELECT v.id, label, value, type, degree FROM (SELECT n AS id, count(*) AS degree FROM (
        SELECT source AS n FROM structural WHERE target = 'post_5' UNION ALL SELECT target FROM structural WHERE source = 'post_5'
        UNION ALL SELECT DISTINCT unnest([parent_id, author_id]) FROM ents WHERE id = 'post_5' UNION ALL SELECT id FROM ents WHERE parent_id = 'post_5' OR author_id = 'post_5'
      ) GROUP BY 1 ORDER BY degree DESC, id LIMIT 20) d JOIN {_VISIBLE} v ON v.id = d.id""",
)
add(
    "node_details_legacy",
    lambda c: explore.legacy_details(c.nodes, c.links, c.communities, "community_3", 10),
    """SELECT * FROM (WITH a AS (SELECT n AS id, count(*) AS k FROM (SELECT target AS n FROM links WHERE source = 'community_3' UNION ALL SELECT source FROM links WHERE target = 'community_3') GROUP BY 1),
    t AS (SELECT a.id, k FROM a JOIN nodes USING (id) ORDER BY k DESC, a.id LIMIT 10)
    SELECT n.id, n.name, val, type, (SELECT count(*) FROM t) AS degree, CAST((SELECT sum(k) FROM a) AS BIGINT) AS true_degree, (SELECT string_agg(id || ':' || k, ',' ORDER BY k DESC, id) FROM t) AS neighbours, subscribers
    FROM nodes n JOIN communities c ON c.name = n.name WHERE n.id = 'community_3')""",
)


def _forest(c: Corpus) -> DataFrame:
    return _entities(c).withColumn("cluster_id", F.when(F.col("type") == "community", F.concat(F.lit("k"), (F.col("value") % 3).cast("string"))))


_KIDS = f"(SELECT parent_id AS pid, count(*) AS n FROM {_VISIBLE} GROUP BY 1)"
_TREE = f"SELECT v.id, type, label, value, author_id, coalesce(n, 0) AS child_count FROM {_VISIBLE} v LEFT JOIN {_KIDS} ON pid = v.id"
add(
    "catalog_tree_of_a_cluster",
    lambda c: explore.community_tree(_forest(c), _hidden(c), "k1", 30),
    f"{_TREE} WHERE type = 'community' AND value % 3 = 1 ORDER BY value DESC, v.id LIMIT 30",
)
add(
    "catalog_tree_of_a_community",
    lambda c: explore.community_tree(_forest(c), _hidden(c), "community_3", 30, 5),
    f"{_TREE} WHERE parent_id = 'community_3' ORDER BY value DESC, v.id LIMIT 30 OFFSET 5",
)
add(
    "cross_linked_authors",
    lambda c: explore.cross_linked_authors(explore.community_tree(_forest(c), _hidden(c), "community_3", 30)),
    f"SELECT string_agg(author_id, ',' ORDER BY author_id) AS authors FROM (SELECT DISTINCT author_id FROM (SELECT * FROM {_VISIBLE} "
    f"WHERE parent_id = 'community_3' ORDER BY value DESC, id LIMIT 30))",
)


def _macro(c: Corpus) -> tuple[DataFrame, DataFrame]:
    shown = _landmarks(c).select("id", F.concat(F.lit("m"), F.col("macro_id").cast("string")).alias("macro_group_id"), (F.col("macro_id") * 2)
        .alias("role"), "size", "distinctiveness", "confidence")
    routes = spatial.bundle_weights(_chain(c), c.points).select("source", "target", (F.col("weight") / 100.0)
        .alias("affinity"), F.col("weight").alias("evidence"))
    hidden = c.spark.range(1).select(F.lit("m2").alias("entity_id"), F.lit(None).cast("timestamp").alias("restored_at"))
    return explore.macro_groups(shown, routes, hidden)


_BW = (
    "(SELECT least(a.community_id, b.community_id) AS source, greatest(a.community_id, b.community_id) AS target, count(*) AS weight "
    "FROM (SELECT 'point_' || (vec_id - 1) AS source, 'point_' || vec_id AS target FROM embeddings WHERE vec_id > 0) l JOIN points a "
    "ON l.source = a.id JOIN points b ON l.target = b.id WHERE a.community_id <> b.community_id GROUP BY 1, 2)")
add(
    "macro_groups",
    lambda c: _macro(c)[0],
    "SELECT 'm' || macro_id AS id, macro_id * 2 AS role, count(*) AS communities, CAST(sum(size) AS BIGINT) AS members FROM landmarks "
    "WHERE macro_id <> 2 GROUP BY macro_id",
)
add(
    "macro_group_links",
    lambda c: _macro(c)[1].select("source", "target", F.round("affinity", 6).alias("affinity"), "evidence"),
    f"SELECT 'm0' AS source, 'm1' AS target, round(least(1.0, avg(weight / 100.0)), 6) AS affinity, CAST(sum(weight) AS BIGINT) AS "
    f"evidence FROM {_BW} WHERE (source % 3 = 0 AND target % 3 = 1) OR (source % 3 = 1 AND target % 3 = 0) HAVING count(*) > 0",
)


@query(
    "graph_json_legacy",
    """SELECT (SELECT count(*) FROM communities) + (SELECT count(*) FROM users) AS n_nodes, (SELECT count(*) FROM relationships) + (SELECT count(*) FROM active) AS n_links,
    (SELECT 'community_' || id FROM communities ORDER BY 'community_' || id LIMIT 1) AS first_id""",
)
def _legacy(c: Corpus) -> DataFrame:
    """The document in pieces is written, read back and parsed."""
    pieces = staged(exports.graph_json_pieces(*explore.legacy_graph(c.communities, c.users, c.kept_activity, c.relationships)), "legacy")
    read = pieces.select("kind", "place", F.from_json("piece", "array<struct<id: string, source: string>>").alias("d"))
    by = read.select("kind", "place", F.size("d").cast("long").alias("n"), F.element_at("d.id", 1).alias("id"))
    n = {k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0).cast("long")).alias(f"n_{k}") for k in ("nodes", "links")}
    return by.agg(n["nodes"], n["links"], F.min_by("id", F.when(F.col("kind") == "nodes", F.col("place"))).alias("first_id"))


add(
    "telemetry_top_users",
    lambda c: search.heaviest(c.nodes, ["user"], 20),
    "SELECT id, w AS value FROM weighted WHERE type = 'user' ORDER BY w DESC, id LIMIT 20",
)


@query("version_diff",
    "SELECT CASE l_linestatus WHEN 'F' THEN 'node' ELSE 'link' END AS entity_type, l_returnflag AS action, count(*) AS n FROM lineitem "
    "JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' AND o_orderkey > 100 GROUP BY 1, 2")
def _version_diff(c: Corpus) -> DataFrame:
    versions = c.table("orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "completed")
        .otherwise("running").alias("status"))
    diffs = c.lines.select(F.col("l_orderkey").alias("version_id"), F.when(F.col("l_linestatus") == "F", "node")
        .otherwise("link").alias("entity_type"), F.col("l_returnflag").alias("action"))
    return explore.version_diff(diffs, versions, 100)


@query("route_table", "SELECT 'graph' AS route, 30 AS n UNION ALL SELECT 'search', 5 UNION ALL SELECT 'top', 7 UNION ALL SELECT 'neighbours', 6")
def _routes(c: Corpus) -> DataFrame:
    """Rows that the facade's reads give for their limits."""
    view = Explorer(staged(c.nodes, "nodes"), staged(c.links, "links"), entities=_entities(c))
    found = {"graph": view.graph(30, 1).where("data_type = 'node'"), "search": view.search("customer#", 5), "top": view.top(["community"], 7),
        "neighbours": view.neighbours("community_3", 6)}
    out = None
    for name, df in found.items():
        row = df.agg(F.lit(name).alias("route"), F.count("*").cast("int").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


add(
    "sitemap_shards",
    lambda c: scopes.sitemap_tiers(_entities(c), _hidden(c), 500).withColumn("k", F.row_number().over(_by_tier())).select("tier", F.floor((F.col(
        "k") - 1) / 5000).cast("int").alias("shard")).groupBy("tier", "shard").agg(F.count("*").alias("entries")),
    f"""SELECT tier, CAST((k - 1) // 5000 AS INTEGER) AS shard, count(*) AS entries FROM (SELECT tier, row_number() OVER (PARTITION BY tier ORDER BY id) AS k FROM (
      SELECT e.id, CASE WHEN type = 'community' THEN 1 WHEN t.id IS NOT NULL THEN 2 ELSE 3 END AS tier FROM {_VISIBLE} e LEFT JOIN (SELECT id FROM {_VISIBLE} WHERE type IN ('user', 'post') ORDER BY value DESC, id LIMIT 500) t ON e.id = t.id)) GROUP BY 1, 2""",
)


def _by_tier():
    from pyspark.sql import Window

    return Window.partitionBy("tier").orderBy("id")


add(
    "render_cap",
    lambda c: client.render_cap(c.nodes, c.links, client.active_users(c.links).select("id", F.col("active_users").alias("metric")), 300, 500),
    """SELECT * FROM (WITH k AS (SELECT n.id, name, val, type FROM weighted n LEFT JOIN degree d ON n.id = d.id LEFT JOIN (SELECT target AS id, count(DISTINCT source) AS m FROM links WHERE source LIKE 'user%' GROUP BY 1) a ON a.id = n.id
      ORDER BY greatest(w, CASE WHEN type = 'community' THEN coalesce(m, 0) ELSE coalesce(degree, 0) END) DESC, n.id LIMIT 300)
    SELECT 'node' AS data_type, id, name, val, type, NULL AS source, NULL AS target FROM k UNION ALL SELECT 'link', source || '->' || target, NULL, NULL, NULL, source, target FROM (SELECT source, target FROM links WHERE source IN (SELECT id FROM k) AND target IN (SELECT id FROM k) ORDER BY source, target LIMIT 500))""",
)
add(
    "client_edge_bundling",
    lambda c: client.bundled_links(_chain(c), c.points).select("source", "target", "n_links", *(F.round(k, 5)
        .alias(k) for k in ("width", "from_x", "to_z"))),
    f"SELECT source, target, weight AS n_links, round(1 + log10(weight), 5) AS width, round(a.x, 5) AS from_x, round(b.z, 5) AS to_z "
    f"FROM {_BW} JOIN (SELECT community_id, avg(pos_x) AS x FROM points GROUP BY 1) a ON source = a.community_id JOIN (SELECT "
    f"community_id, avg(pos_z) AS z FROM points GROUP BY 1) b ON target = b.community_id",
)
add("linked_only_without_links", lambda c: client.linked_only(c.nodes, c.links.limit(0)), "SELECT * FROM nodes")

# --- life cycles
_T = "2024-01-15 12:00:00"


def _requests(c: Corpus) -> DataFrame:
    t = F.lit(_T).cast("timestamp")
    return c.users.select(
        "id", (F.col("id") % 10).alias("priority"), (t + F.make_dt_interval(mins=(F.col("id") % 120 - 60)
            .cast("int"))).alias("next_due_at"), (F.col("id") % 6 != 0).alias("enabled"),
        F.when(F.col("id") % 4 == 0, "backlog").otherwise("active").alias("cohort"), F.when(F.col("id") % 5 == 0, t - F.make_dt_interval(
            hours=F.lit(2))).alias("last_completed_at"),
    )


def _attempts(c: Corpus) -> DataFrame:
    """Every third request has attempts; some hold a lease, some have failed for the last time."""
    t = F.lit(_T).cast("timestamp")
    n = F.explode(F.sequence(F.lit(0), (F.col("id") % 5).cast("int"))).alias("number")
    rows = c.users.where("id % 3 = 0").select(F.col("id").alias("request_id"), n)
    live = (F.col("number") == F.col("request_id") % 5) & (F.col("request_id") % 2 == 0)
    return rows.select(
        "request_id", "number", F.when(live, "leased").otherwise("retryable_failure").alias("state"), F.concat(F.lit("w"), (F.col(
            "request_id") % 4).cast("string")).alias("worker"),
        (t - F.make_dt_interval(hours=F.lit(3))).alias("started_at"), (t + F.make_dt_interval(mins=F.when(F.col("request_id") % 4 == 0, -1)
            .otherwise(5))).alias("lease_expires_at"), F.lit(None).cast("timestamp").alias("finished_at"),
    )


_LEASED = "request_id % 2 = 0 AND number = request_id % 5"
_ATT = "(SELECT id AS request_id, unnest(generate_series(0, id % 5)) AS number FROM users WHERE id % 3 = 0)"
add(
    "expire_leases",
    lambda c: lifecycle.expired(_attempts(c), _T).select("request_id", "number", "state", "finished_at"),
    f"SELECT request_id, CAST(number AS INTEGER) AS number, CASE WHEN {_LEASED} AND request_id % 4 <> 0 THEN 'leased' ELSE "
    f"'retryable_failure' END AS state, CASE WHEN {_LEASED} AND request_id % 4 = 0 THEN TIMESTAMP '{_T}' END AS finished_at FROM {_ATT}",
)
_DUE = f"""SELECT id, id % 10 AS priority, TIMESTAMP '{_T}' + CAST(id % 120 - 60 AS INTEGER) * INTERVAL 1 MINUTE AS next_due_at, CAST(number AS INTEGER) AS number FROM (
  SELECT id, CASE WHEN id % 3 = 0 AND id % 5 <> 0 THEN id % 5 + 1 ELSE 0 END AS number FROM users WHERE id % 6 <> 0 AND id % 120 <= 60 AND NOT (id % 3 = 0 AND id % 2 = 0 AND id % 4 <> 0)) WHERE number < 5"""
add("due_requests", lambda c: lifecycle.due(_requests(c), lifecycle.expired(_attempts(c), _T), _T), _DUE)
add(
    "claim_lease",
    lambda c: lifecycle.claimed(_requests(c), _attempts(c), "me", _T)[0].select("request_id", "number", "state", "worker", "lease_expires_at"),
    f"SELECT id AS request_id, number, 'leased' AS state, 'me' AS worker, TIMESTAMP '{_T}' + INTERVAL 10 MINUTE AS lease_expires_at "
    f"FROM ({_DUE}) ORDER BY priority DESC, next_due_at, id LIMIT 1",
)
add(
    "renew_lease",
    lambda c: lifecycle.renewed(_attempts(c), 18, "w2", _T).where("request_id = 18").select("number", "lease_expires_at"),
    f"SELECT CAST(number AS INTEGER) AS number, CASE WHEN number = 3 THEN TIMESTAMP '{_T}' + INTERVAL 10 MINUTE ELSE TIMESTAMP '{_T}' + "
    f"INTERVAL 5 MINUTE END AS lease_expires_at FROM {_ATT} WHERE request_id = 18",
)


def _outcomes(c: Corpus) -> DataFrame:
    kind = F.element_at(F.array(F.lit("complete"), F.lit("retryable_failure"), F.lit("cancelled")), (F.col("id") % 9 / 3 + 1).cast("int"))
    return c.users.where("id % 6 = 0").select(F.col("id").alias("request_id"), F.concat(F.lit("w"), (F.col("id") % 4)
        .cast("string")).alias("worker"), kind.alias("outcome"))


_OUT = (
    "CASE CAST(floor(request_id % 9 / 3) AS INTEGER) WHEN 0 THEN 'complete' WHEN 1 THEN CASE WHEN number >= 4 THEN 'permanent_failure' "
    "ELSE 'retryable_failure' END ELSE 'cancelled' END")
add(
    "finish_attempts",
    lambda c: lifecycle.finished(_requests(c), _attempts(c), _outcomes(c), _T)[1].select("request_id", "number", "state", F.col(
        "finished_at").isNotNull().alias("ended")),
    f"SELECT request_id, CAST(number AS INTEGER) AS number, CASE WHEN {_LEASED} THEN CASE WHEN request_id % 6 = 0 THEN {_OUT} ELSE "
    f"'leased' END ELSE 'retryable_failure' END AS state, {_LEASED} AND request_id % 6 = 0 AS ended FROM {_ATT}",
)
add(
    "finish_requests",
    lambda c: lifecycle.finished(_requests(c), _attempts(c), _outcomes(c), _T)[0].select("id", F.col("last_completed_at")
        .alias("done"), F.when(F.col("next_due_at") >= F.lit("2024-01-22").cast("timestamp"), "fresh")
        .when(F.col("next_due_at") > F.lit("2024-01-15 13:00:00").cast("timestamp"), "waits").otherwise("as it was")
        .alias("due")).where("id % 6 = 0 and id % 9 < 3"),
    f"SELECT id, TIMESTAMP '{_T}' AS done, 'fresh' AS due FROM users WHERE id % 6 = 0 AND id % 9 < 3",
)


def _jobs(c: Corpus) -> DataFrame:
    t = F.lit(_T).cast("timestamp")
    state = F.element_at(F.array(F.lit("queued"), F.lit("crawling"), F.lit("failed"), F.lit("success")), (F.col("id") % 4 + 1).cast("int"))
    return c.users.select("id", state.alias("status"), (F.col("id") % 5).alias("retry_count"), F.lit(3)
        .alias("max_retries"), F.when(F.col("id") % 3 > 0, t + F.make_dt_interval(mins=(F.col("id") % 7 - 3)
        .cast("int"))).alias("next_retry_at"), (t - F.make_dt_interval(mins=(F.col("id") % 50).cast("int")))
        .alias("last_attempt"), (t - F.make_dt_interval(days=F.lit(1))).alias("visible_at"))


_STATE = "['queued', 'crawling', 'failed', 'success'][id % 4 + 1]"
add(
    "requeue_failed_jobs",
    lambda c: lifecycle.requeued(_jobs(c), _T).select("id", "status", "visible_at"),
    f"SELECT id, CASE WHEN b THEN 'queued' ELSE {_STATE} END AS status, CASE WHEN b THEN TIMESTAMP '{_T}' ELSE TIMESTAMP '{_T}' - "
    f"INTERVAL 1 DAY END AS visible_at FROM (SELECT id, id % 4 = 2 AND id % 3 > 0 AND id % 7 <= 3 AND id % 5 < 3 AS b FROM users)",
)
add(
    "reset_stuck_jobs",
    lambda c: lifecycle.reset(_jobs(c), _T, 30).select("id", "status"),
    f"SELECT id, CASE WHEN id % 4 = 1 AND id % 50 > 30 THEN 'queued' ELSE {_STATE} END AS status FROM users",
)


@query("scheduled_job_crud",
    "SELECT id, CASE WHEN id = 3 THEN '@weekly' ELSE '@daily' END AS schedule, id <> 4 AS enabled, CASE WHEN id = 5 THEN TIMESTAMP "
    "'2024-01-15 12:00:00' END AS last_run FROM users WHERE id BETWEEN 1 AND 9 AND id <> 2")
def _schedules(c: Corpus) -> DataFrame:
    """Created, changed, switched off, run and deleted."""
    space = _space(c)
    rows = c.users.where("id between 1 and 9").select("id", F.lit("@daily").alias("schedule"), F.lit(True)
        .alias("enabled"), F.lit(None).cast("timestamp").alias("last_run"))
    space.insert("jobs", rows, ["id"])
    jobs = space.read("jobs")
    space.upsert("jobs", jobs.where("id = 3").withColumn("schedule", F.lit("@weekly")), ["id"])
    space.upsert("jobs", space.read("jobs").where("id = 4").withColumn("enabled", F.lit(False)), ["id"])
    space.upsert("jobs", space.read("jobs").where("id = 5").withColumn("last_run", F.lit(_T).cast("timestamp")), ["id"])
    space.delete("jobs", rows.where("id = 2").select("id"))
    return space.read("jobs")


add(
    "discovery_daily_budget",
    lambda c: incremental.discoveries(c.events.select(F.col("user_id").alias("target"), F.col("event_id")
        .alias("score"), (F.col("event_id") % 97 == 0).alias("mention")), 40, c.users.where("id % 10 = 0 and id <= 100")
        .select(F.col("id").alias("target"), F.when(F.col("id") <= 30, F.lit(_T)).otherwise(F.lit("2024-01-14"))
        .cast("timestamp").alias("at")), _T),
    "SELECT user_id AS target, CAST(sum(event_id) AS BIGINT) AS score, max(CAST(event_id % 97 = 0 AS INTEGER)) AS mention FROM events "
    "WHERE NOT (user_id % 10 = 0 AND user_id BETWEEN 0 AND 100 AND user_id IN (SELECT id FROM users)) GROUP BY 1 ORDER BY mention "
    "DESC, score DESC, target LIMIT 40 - (SELECT count(*) FROM users WHERE id IN (0, 10, 20, 30))",
)

# --- graph kernels


def _layers(c: Corpus) -> DataFrame:
    """Affinity layers over each community's strongest links."""
    scored = staged(_affinity(c), "scored")
    kept = ranking.strongest_edges(scored.where("affinity > 0").select("u", "v", F.col("affinity").alias("weight")), 24, 1_000_000)
    return staged(affinity.layers_of(scored.join(kept.select("u", "v"), ["u", "v"], "left_semi")), "layers")


def _every_layer(c: Corpus) -> DataFrame:
    """Affinity layers over all links with any affinity."""
    return staged(affinity.layers_of(staged(_affinity(c), "scored").where("affinity > 0")), "layers")


add("multiplex_louvain", lambda c: communities.multiplex_partitions(_layers(c), [0.5, 1.0, 2.0]))
add(
    "multiplex_graph",
    lambda c: communities.multiplex(affinity.layers_of(_affinity(c))).select("u", "v", F.round("weight", 5)
    .alias("weight")),
    "SELECT * FROM (WITH s AS (" + " UNION ALL ".join(f"SELECT u, v, '{k}' AS layer, {w} AS w, raw_{k} AS raw FROM aff WHERE raw_{k} > 0"
    for k, w in affinity.LAYERS.items()) + ") SELECT u, v, round(sum(raw * w / (SELECT sum(w) FROM (SELECT DISTINCT layer, w FROM s))), 5) AS weight FROM s GROUP BY 1, 2)",
)


@query("fine_partition_selection")
def _fine(c: Corpus) -> DataFrame:
    """The partition with most modularity whatever the gate says of so few communities, and what it says."""
    tried = staged(communities.multiplex_partitions(_every_layer(c), list(communities.FINE)), "tried")
    gate = communities.partition_gate(tried.withColumn("level", F.lit(1)), tried.select("id").distinct().count())
    q = tried.groupBy("resolution").agg(F.max("modularity").alias("modularity"))
    return gate.join(q, "resolution").select("resolution", "communities", "held", "single", "median", "accepted", F.round("modularity", 6)
        .alias("modularity")).orderBy(F.desc("accepted"), F.desc("modularity"), "resolution")


@query("macro_partition_select")
def _macro_select(c: Corpus) -> DataFrame:
    """Macro groups of the communities' affinity graph, here by nation, best resolution first."""
    graph = communities.community_graph(_affinity(c).select("u", "v", "affinity"), _groups(c).withColumnRenamed("group_id", "community_id"))
    graph = staged(graph, "macro-graph")
    return communities.macro_selection(communities.hierarchy(graph, list(communities.MACRO)), graph)


add("nested_communities", lambda c: communities.nested_communities(c.points.select("id", "val"), _chain(c)))
add("flat_communities", lambda c: communities.flat_communities(c.points.select("id", "val"), _chain(c)))
add("communities_from_hierarchy", lambda c: communities.from_hierarchy(communities.nested_communities(c.points.select("id", "val"), _chain(c))))
add("store_hierarchy", lambda c: communities.stored_hierarchy(communities.nested_communities(c.points.select("id", "val"), _chain(c)), c.points))


@query("octree_repulsion", "SELECT count(*) AS n, true AS exact, true AS near FROM points")
def _octree(c: Corpus) -> DataFrame:
    """Whether the tree's sums are those of all pairs, with every cell opened and with small ones as one body, in blocks of points."""

    def compare(frame):
        import numpy as np
        import pandas as pd

        pos = frame[["pos_x", "pos_y", "pos_z"]].to_numpy()
        mass = 1.0 + np.arange(len(pos)) % 3
        d = pos[:, None] - pos[None]
        pairs = mass[:, None] * ((mass[None] / np.maximum((d * d).sum(axis=2), 1e-6))[:, :, None] * d).sum(axis=1)
        whole, part = (octree.repulsion(pos, mass, theta=t) for t in (0.0, 0.8))
        size = max(np.linalg.norm(pairs), 1e-12)
        return pd.DataFrame({"n": [len(frame)], "exact": [bool(np.linalg.norm(whole - pairs) <= 1e-6 * size)], "near": [bool(np.linalg.norm(
            part - pairs) <= 0.15 * size)]})

    blocks = max(1, c.points.count() // 500)
    by = c.points.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).groupBy("block").applyInPandas(compare,
        "n long, exact boolean, near boolean")
    return by.agg(F.sum("n").alias("n"), F.bool_and("exact").alias("exact"), F.bool_and("near").alias("near"))


@query("warm_layout_keeps_pins", "SELECT id, round(pos_x, 6) AS pos_x FROM points WHERE community_id < 5")
def _pins(c: Corpus) -> DataFrame:
    """A warm world layout: what is pinned stays where it was."""
    nodes = c.points.select("id", "val", *(F.when(F.col("community_id") < 5, F.col(a)).alias(a) for a in layout.AXES), (F.col("community_id") < 5)
        .alias("pinned"))
    laid = layout.layout(nodes, _point_links(c), "world")
    return laid.join(c.points.where("community_id < 5").select("id"), "id", "left_semi").select("id", F.round("pos_x", 6).alias("pos_x"))


# --- builds
_PLACES = """CASE WHEN id IN (SELECT id FROM points WHERE community_id < 3) THEN 'warm-start' WHEN id IN (SELECT id FROM points WHERE community_id < 5) THEN 'force-layout'
  WHEN id IN (SELECT id FROM points WHERE community_id < 7) THEN 'overlap-seeded' ELSE 'deterministic-global' END"""
add(
    "warm_start_chain",
    lambda c: catalog.warm_start(c.points.select("id", F.lit("nowhere").alias("anchor_id")), c.points.where("community_id < 3"), c.points.limit(
        0), c.points.where("community_id < 5"), c.points.where("community_id < 7")).select("id", "provenance"),
    f"SELECT id, {_PLACES} AS provenance FROM points",
)
add(
    "cold_vs_warm",
    lambda c: c.spark.createDataFrame([(p, revisions.placed_anew(p or None)) for p in ("", "another rule", revisions.PLACEMENT)],
    "placement string, cold boolean"),
    f"SELECT '' AS placement, true AS cold UNION ALL SELECT 'another rule', true UNION ALL SELECT '{revisions.PLACEMENT}', false",
)
add(
    "validation_of_positions",
    lambda c: catalog.validation(_entities(c).where("type = 'user'"), positions=c.points, documents=c.posts.where("id < 50")
        .select(C.typed_id("post", "id").alias("id"))).select("n", "bad_positions", "collapsed", "stray_documents", "passed"),
    "SELECT (SELECT count(*) FROM users) AS n, 0 AS bad_positions, false AS collapsed, (SELECT count(*) FROM posts WHERE id < 50) AS "
    "stray_documents, false AS passed",
)
add(
    "metrics_collector",
    lambda c: revisions.collected({"communities": c.communities, "users": c.users, "posts": c.posts}, c.nodes),
    "SELECT 'rows' AS name, 'communities' AS label, count(*) AS value FROM communities UNION ALL SELECT 'rows', 'users', count(*) FROM "
    "users UNION ALL SELECT 'rows', 'posts', count(*) FROM posts UNION ALL SELECT 'nodes', type, count(*) FROM nodes GROUP BY type",
)
add(
    "version_record",
    lambda c: revisions.version_record(c.table("orders").select(F.col("o_orderkey").alias("id")), c.nodes, c.links, NOW, 1.5),
    f"SELECT (SELECT max(o_orderkey) + 1 FROM orders) AS id, (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM links) "
    f"AS link_count, 'completed' AS status, TIMESTAMP '{NOW}' AS created_at, CAST(1.5 AS DOUBLE) AS seconds",
)


def _catalog(c: Corpus) -> revisions.Catalog:
    return revisions.build_catalog(c, NOW)


_UP_TO = f"(SELECT * FROM posts WHERE created_at <= TIMESTAMP '{NOW}')"
_SAID = f"(SELECT * FROM comments WHERE created_at <= TIMESTAMP '{NOW}')"


@query(
    "build_catalog",
    f"SELECT (SELECT count(*) FROM communities) AS n_community, (SELECT count(*) FROM users) AS n_user, (SELECT count(*) FROM {_UP_TO}) "
    f"AS n_post, (SELECT count(*) FROM {_SAID}) AS n_comment, 0 AS empty_labels, 0 AS bad_positions, false AS collapsed, 0 AS "
    f"stray_documents, true AS passed",
)
def _built(c: Corpus) -> DataFrame:
    """A catalog is built, gated, published and read back."""
    store = _store(c)
    revisions.publish_catalog(store, _catalog(c))
    return store.read("report").select("n_community", "n_user", "n_post", "n_comment", "empty_labels", "bad_positions", "collapsed",
        "stray_documents", "passed")


def _members(c: Corpus) -> DataFrame:
    """Communities by nation, and users with the one that they are most active in."""
    home = catalog.best_anchor(c.kept_activity).select(C.typed_id("user", "user_id").alias("id"), "community_id").join(c.communities.select(F.col(
        "id").alias("community_id"), "nation"), "community_id")
    return c.communities.select(C.typed_id("community", "id").alias("id"), F.col("nation").cast("string")
        .alias("group_id")).unionByName(home.select("id", F.col("nation").cast("string").alias("group_id")))


_CAPS = {"community": 15, "user": 300, "post": 40, "comment": 0}
_SIZED = f"""(SELECT id, type, value AS w, home FROM (
  SELECT 'community_' || id AS id, 'community' AS type, subscribers AS value, nation AS home FROM communities
  UNION ALL SELECT 'user_' || u.id, 'user', coalesce(t, 0), nation FROM users u LEFT JOIN (SELECT author_id, sum(n) AS t FROM (SELECT author_id, count(*) AS n FROM {_UP_TO} GROUP BY 1 UNION ALL SELECT author_id, count(*) FROM {_SAID} GROUP BY 1) GROUP BY 1) a ON a.author_id = u.id
    LEFT JOIN (SELECT user_id, first(community_id ORDER BY activity_count DESC, community_id) AS c FROM active GROUP BY 1) h ON h.user_id = u.id LEFT JOIN communities ON communities.id = c
  UNION ALL SELECT 'post_' || id, 'post', greatest(score, 0), NULL FROM {_UP_TO}))"""
_KEPT = (
    f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY w DESC, id) AS k FROM {_SIZED}) WHERE k <= CASE type WHEN "
    f"'community' THEN 15 WHEN 'user' THEN 300 ELSE 40 END)")
_RLINKS = f"""(SELECT * FROM (WITH k AS (SELECT * FROM {_KEPT}),
  a AS (SELECT 'user_' || user_id AS source, 'community_' || community_id AS target, 'user_activity' AS relation, activity_count AS weight FROM active WHERE 'user_' || user_id IN (SELECT id FROM k) AND 'community_' || community_id IN (SELECT id FROM k) ORDER BY weight DESC, source, target LIMIT 900),
  o AS (SELECT 'community_' || u AS source, 'community_' || v AS target, 'overlap' AS relation, overlap_count AS weight FROM pairs WHERE overlap_count >= 2 AND 'community_' || u IN (SELECT id FROM k) AND 'community_' || v IN (SELECT id FROM k) ORDER BY weight DESC, source, target LIMIT 900),
  s AS (SELECT 'user_' || author_id AS source, 'post_' || id AS target, 'authorship' AS relation, 1 AS weight FROM posts UNION ALL SELECT 'post_' || id, 'community_' || community_id, 'published_in', 1 FROM posts),
  b AS (SELECT * FROM s WHERE source IN (SELECT id FROM k) AND target IN (SELECT id FROM k))
  SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM o UNION ALL SELECT * FROM b) ORDER BY weight DESC, source, target, relation LIMIT 900))"""


def _revision(c: Corpus, built: revisions.Catalog | None = None) -> revisions.Revision:
    built = _catalog(c) if built is None else built
    return revisions.build_revision(built, _members(c), c.kept_activity, c.kept_relationships, caps=_CAPS, most_nodes=400, most_links=900)


_EVERY = f"(SELECT * FROM {_SIZED} UNION ALL SELECT 'comment_' || id, 'comment', greatest(score, 0), NULL FROM {_SAID})"
_EVERY_LINK = f"""(SELECT * FROM (WITH k AS (SELECT id FROM {_EVERY}),
  s AS (SELECT 'user_' || user_id AS source, 'community_' || community_id AS target FROM active
    UNION ALL SELECT 'community_' || u, 'community_' || v FROM pairs WHERE overlap_count >= 2
    UNION ALL SELECT 'user_' || author_id, 'post_' || id FROM {_UP_TO} UNION ALL SELECT 'post_' || id, 'community_' || community_id FROM {_UP_TO}
    UNION ALL SELECT 'user_' || author_id, 'comment_' || id FROM {_SAID}
    UNION ALL SELECT 'comment_' || id, CASE WHEN parent_id LIKE 't1_%' THEN 'comment_' ELSE 'post_' END || substr(parent_id, 4) FROM {_SAID})
  SELECT * FROM s WHERE source IN (SELECT id FROM k) AND target IN (SELECT id FROM k)))"""


@query("publish_revision",
    f"SELECT (SELECT count(*) FROM {_EVERY}) AS n_nodes, (SELECT count(*) FROM {_EVERY_LINK}) AS n_links, (SELECT count(DISTINCT home) FROM "
    f"{_EVERY}) AS n_communities, true AS passed")
def _published(c: Corpus) -> DataFrame:
    """A revision of all entities and all their links is built, gated, published and read back by the pointer."""
    store = _store(c)
    whole = revisions.build_revision(_catalog(c), _members(c), c.kept_activity, c.kept_relationships, caps=revisions.EVERY, most_nodes=None,
        most_links=None)
    revisions.publish_revision(store, whole)
    return store.read("summary").select("n_nodes", "n_links", "n_communities", "passed")


add("revision_nodes", lambda c: _revision(c).nodes.select("id", "type"), f"SELECT id, type FROM {_KEPT}")
add(
    "revision_links",
    lambda c: _revision(c).links.select("source", "target", "relation", "weight"),
    f"SELECT source, target, relation, weight FROM {_RLINKS}",
)
add(
    "revision_members",
    lambda c: _revision(c).members.groupBy("community_id").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*")
    .alias("communities")),
    f"SELECT n, count(*) AS communities FROM (SELECT home, count(*) AS n FROM {_KEPT} WHERE home IS NOT NULL GROUP BY 1) GROUP BY 1",
)
add(
    "revision_routes",
    lambda c: _revision(c).routes.groupBy("weight").agg(F.count("*").alias("n")),
    f"SELECT weight, count(*) AS n FROM (SELECT least(a.home, b.home) AS s, greatest(a.home, b.home) AS t, CAST(sum(l.weight) AS "
    f"BIGINT) AS weight FROM {_RLINKS} l JOIN {_KEPT} a ON a.id = l.source JOIN {_KEPT} b ON b.id = l.target WHERE a.home <> b.home "
    f"GROUP BY 1, 2) GROUP BY 1",
)


@query("stable_communities", f"SELECT count(DISTINCT home) AS communities, count(DISTINCT home) AS kept FROM {_KEPT}")
def _stable(c: Corpus) -> DataFrame:
    """The next revision of the same groups under other names keeps the ids of the one before."""
    built = _catalog(c)
    first = _revision(c, built)
    other = _members(c).withColumn("group_id", F.concat(F.lit("other "), "group_id"))
    second = revisions.build_revision(built, other, c.kept_activity, c.kept_relationships, previous=first, caps=_CAPS, most_nodes=400, most_links=900)
    a, b = (r.communities.select("community_id") for r in (first, second))
    return b.agg(F.count("*").alias("communities")).crossJoin(a.join(b, "community_id", "left_semi").agg(F.count("*").alias("kept")))  # one-row frames


@query("require_published_catalog", "SELECT true AS refused_before, true AS read_after, true AS bad_refused, true AS still_there")
def _required(c: Corpus) -> DataFrame:
    store = _store(c)

    def fails(act, error: type[Exception]) -> bool:
        try:
            act()
        except error:
            return True
        return False

    before = fails(lambda: store.read("users"), LookupError)
    store.publish({"users": c.users})
    name = store.current()
    store.gates = {"never": lambda tables: False}
    bad = fails(lambda: store.publish({"users": c.users.limit(0)}), publish.Rejected)
    after = store.read("users").count() == c.users.count()
    return c.spark.createDataFrame([(before, after, bad, store.current() == name)],
        "refused_before boolean, read_after boolean, bad_refused boolean, still_there boolean")


def _shown(c: Corpus) -> DataFrame:
    """Communities by nation presented, in five macro groups by region."""
    members = _groups(c).withColumnRenamed("group_id", "community_id")
    macro = c.table("nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("group_id")).join(members.select(F.col(
        "community_id").alias("id")).distinct(), "id")
    identities = publish.macro_identities(macro.limit(0).select("id", "group_id", F.lit(1).alias("size"), F.lit("")
        .alias("role")), macro.withColumn("size", F.lit(1)))
    names = c.communities.select("id", "name")
    return revisions.presented(staged(_affinity(c).select("u", "v", "affinity"), "pairs"), members, macro, names, names.select("id", F.col(
        "name").alias("text")), identities)


add(
    "persist_communities",
    lambda c: _shown(c).select(F.col("community_id").alias("nation"), "size", F.round("confidence", 6)
    .alias("confidence"), F.col("colour").rlike("^#[0-9A-F]{6}$").alias("coloured"), F.size("representatives")
    .alias("n_representatives")),
    "SELECT nation, count(*) AS size, round(least(1.0, count(*) / 20.0), 6) AS confidence, true AS coloured, CAST(least(12, count(*)) "
    "AS INTEGER) AS n_representatives FROM communities GROUP BY 1",
)


@query("promotion_gates",
    "SELECT count(DISTINCT n_regionkey) AS n_groups, (SELECT min(n) FROM (SELECT n_regionkey, count(DISTINCT nation) AS n FROM "
    "communities JOIN nation ON n_nationkey = nation GROUP BY 1)) AS least, CAST(0.0 AS DOUBLE) AS fallback_part, false AS passed FROM "
    "communities JOIN nation ON n_nationkey = nation")
def _promotion(c: Corpus) -> DataFrame:
    return revisions.promotion_gates(_shown(c))


@query("stable_macro_identities", "SELECT 'm' || macro_id AS id, macro_id AS kept FROM landmarks GROUP BY macro_id")
def _macro_ids(c: Corpus) -> DataFrame:
    """Groups of the same communities under other names keep their ids and roles."""
    old = _landmarks(c).select("id", F.concat(F.lit("m"), F.col("macro_id").cast("string")).alias("group_id"), "size", F.element_at(F.array(
        *map(F.lit, communities.PALETTE)), (F.col("macro_id") + 1).cast("int")).alias("role"))
    found = publish.macro_identities(old, old.withColumn("group_id", F.concat(F.lit("new "), "group_id")).drop("role"))
    rows = [(v["stable_id"], communities.PALETTE.index(v["role"])) for v in found.values()]
    return c.spark.createDataFrame(rows, "id string, kept int")


add("label_fallback", lambda c: scopes.labels(c.communities.select(F.col("nation").alias("group_id"), F.concat(F.lit("topic"), (F.col("id") % 4).cast("string")).alias("token"), F.row_number().over(_by_nation()).alias("rank"))), """
    SELECT group_id, base || CASE WHEN k = 1 THEN '' ELSE ' ' || k END AS label, fingerprint FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY group_id) AS k FROM (
      SELECT group_id, string_agg('T' || substr(token, 2), ' · ' ORDER BY rank) FILTER (rank <= 3) AS base, sha256(string_agg(token, '|' ORDER BY token)) AS fingerprint
      FROM (SELECT nation AS group_id, 'topic' || id % 4 AS token, row_number() OVER (PARTITION BY nation ORDER BY id) AS rank FROM communities) GROUP BY 1))""")  # fmt: skip


def _by_nation():
    from pyspark.sql import Window

    return Window.partitionBy("nation").orderBy("id")


add(
    "suppression_region_page",
    lambda c: spatial.region(c.points, _suppressed(c), (-1.0, 1.0, -1.0, 1.0, -1.0, 1.0), "inspect", 30, 10)
    .select("id"),
    "SELECT id FROM points WHERE pos_x BETWEEN -1 AND 1 AND pos_y BETWEEN -1 AND 1 AND pos_z BETWEEN -1 AND 1 AND type IN "
    "('community', 'user', 'post') AND NOT (community_id = 3 AND type <> 'user') ORDER BY CAST(val AS BIGINT) DESC, id LIMIT 30 OFFSET "
    "10",
)
add("catalog_documents", lambda c: _docs(c).select("id", F.col("sensitive")), "SELECT id, sensitive FROM docs")
