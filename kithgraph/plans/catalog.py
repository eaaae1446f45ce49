"""The catalog of entities: metrics, positions, documents, validation and checksum."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithgraph.functions.columns import label, typed_id
from kithgraph.operators.ranking import first_by
from kithgraph.operators.spatial import structural
from kithgraph.plans.staging import staged

#: Communities from which on a user with a name like a bot's counts as automated.
BOT_COMMUNITIES = 20
#: Names of users that are automated whatever they write.
KNOWN_BOTS = ["automoderator"]
#: Coordinates beyond this one are no places.
FARTHEST = 1e12


def automated(users: DataFrame, active: DataFrame, known: list[str], overrides: DataFrame) -> DataFrame:
    """id of automated users: many communities and a bot's name, a known name, or set by hand (user_id, automated)."""
    reach = active.groupBy("user_id").agg(F.count_distinct("community_id").alias("reach"))
    j = users.join(reach, F.col("id") == F.col("user_id"), "left").drop("user_id").join(overrides.select(F.col("user_id")
        .alias("id"), "automated"), "id", "left")
    guess = ((F.coalesce("reach", F.lit(0)) >= BOT_COMMUNITIES) & F.lower("username").endswith("bot")) | F.lower("username").isin(*known)
    return j.where(F.coalesce("automated", guess)).select("id")


def user_metrics(users: DataFrame, posts: DataFrame, comments: DataFrame) -> DataFrame:
    p = posts.select("author_id", "community_id", F.lit(1).alias("p"))
    c = comments.select("author_id", "community_id", F.lit(0).alias("p"))
    m = p.unionByName(c).groupBy("author_id").agg(F.sum("p").alias("n_posts"), F.sum(1 - F.col("p")).alias("n_comments"), F.count_distinct(
        "community_id").alias("n_communities"), F.count("*").alias("total"))
    j = users.join(m, F.col("id") == F.col("author_id"), "left")
    return j.select("id", *(F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in ("n_posts", "n_comments", "n_communities", "total")))


def community_metrics(communities: DataFrame, posts: DataFrame, comments: DataFrame, bots: DataFrame) -> DataFrame:
    """Without what automated users wrote, and without comments on their posts."""
    b = bots.select(F.col("id").alias("author_id"))
    p = posts.join(b, "author_id", "left_anti")
    c = comments.join(b, "author_id", "left_anti").join(posts.join(b, "author_id", "left_semi").select(F.col("id")
        .alias("post_id")), "post_id", "left_anti")
    both = p.select("community_id", "author_id", F.lit(1).alias("p")).unionByName(c.select("community_id", "author_id", F.lit(0).alias("p")))
    m = both.groupBy("community_id").agg(F.sum("p").alias("n_posts"), F.sum(1 - F.col("p")).alias("n_comments"), F.count_distinct(
        "author_id").alias("n_authors"))
    j = communities.join(m, F.col("id") == F.col("community_id"), "left")
    return j.select("id", *(F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in ("n_posts", "n_comments", "n_authors")))


def post_metrics(posts: DataFrame, comments: DataFrame) -> DataFrame:
    top = F.col("parent_id").isNull() | ~F.col("parent_id").like("t1_%")
    m = comments.groupBy("post_id").agg(F.count("*").alias("n_comments"), F.count_if(top).alias("n_top"), F.count_if(~top).alias("n_replies"))
    j = posts.join(m, F.col("id") == F.col("post_id"), "left")
    return j.select("id", *(F.coalesce(k, F.lit(0)).alias(k) for k in ("n_comments", "n_top", "n_replies")))


def comment_metrics(comments: DataFrame) -> DataFrame:
    """Replies of each comment."""
    m = comments.groupBy("parent_id").agg(F.count("*").alias("n_replies"))
    j = comments.withColumn("_key", F.concat(F.lit("t1_"), "id")).join(m.select(F.col("parent_id").alias("_key"), "n_replies"), "_key", "left")
    return j.select("id", F.coalesce("n_replies", F.lit(0)).alias("n_replies"))


def metrics(communities: DataFrame, users: DataFrame, posts: DataFrame, comments: DataFrame, bots: DataFrame) -> DataFrame:
    """id and counts of every entity (null where a type has none of the kind), as galaxy metrics: without what automated users wrote.

    Comments on automated users' posts count only where their posts do, so nowhere.
    """
    b = bots.select(F.col("id").alias("author_id"), F.lit(True).alias("_by")).distinct()
    theirs = posts.join(b, "author_id", "left_semi").select(F.col("id").alias("post_id"), F.lit(True).alias("_on")).distinct()
    p = posts.join(b, "author_id", "left_anti")
    flagged = comments.join(b, "author_id", "left").join(staged(theirs, "metrics-automated"), "post_id", "left")
    left_out = F.col("_by").isNotNull() | F.col("_on").isNotNull()
    c = flagged.where(~left_out).drop("_by", "_on")
    # What users and communities count comes from one table of both, so the rows are dealt out once.
    ends = ["author_id", "community_id"]
    both = p.select(*ends, F.lit(1).alias("p")).unionByName(c.select(*ends, F.lit(0).alias("p"))).groupBy(*ends).agg(F.sum("p")
        .alias("p"), F.count("*").alias("n"))
    both = staged(both, "metrics-activity")

    def summed(rows: DataFrame, key: str, other: str, name: str) -> DataFrame:
        m = both.groupBy(key).agg(F.sum("p").alias("n_posts"), F.sum(F.col("n") - F.col("p")).alias("n_comments"), F.count(other).alias(name))
        j = rows.select("id").join(m, F.col("id") == F.col(key), "left")
        return j.select("id", *(F.coalesce(k, F.lit(0)).alias(k) for k in ("n_posts", "n_comments", name)))

    parts = {
        "community": summed(communities, "community_id", "author_id", "n_authors"),
        "user": summed(users, "author_id", "community_id", "n_communities"),
        "post": post_metrics(posts, c),
        "comment": comment_metrics(c).unionByName(flagged.where(left_out).select("id", F.lit(0).alias("n_replies"))),
    }
    named = [df.withColumn("id", typed_id(t, "id")) for t, df in parts.items()]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), named)


def best_anchor(active: DataFrame) -> DataFrame:
    """The community in which each user is most active, the smallest id of ties."""
    kept = first_by(active, ["user_id"], [F.desc("activity_count"), F.asc("community_id")])
    return kept.select("user_id", "community_id", "activity_count")


def warm_start(entities: DataFrame, previous: DataFrame, anchors: DataFrame, placed: DataFrame | None = None, related: DataFrame | None = None,
    near: float = 0.0) -> DataFrame:
    """id, position and provenance of entities (id, anchor_id), from the first source that has one.

    In order: where it was before (previous), where this build's layout put it (placed), at
    its anchor (anchors), at the strongest positioned neighbour (related: id, pos_x, pos_y,
    pos_z), else by a hash of its id. Beside an anchor or neighbour it is moved by a hash up to `near`.
    """
    empty = previous.limit(0)
    steps = [("warm-start", previous, "id", 0.0), ("force-layout", empty if placed is None else placed, "id", 0.0), ("community-seeded",
        anchors, "anchor_id", near), ("overlap-seeded", empty if related is None else related, "id", near)]
    j = entities.select("id", "anchor_id")
    for k, (_, source, key, _) in enumerate(steps):
        j = j.join(source.select(F.col("id").alias(key), *(F.col(f"pos_{a}").alias(f"_{k}{a}") for a in "xyz")), key, "left")
    spread = {a: F.pmod(F.xxhash64("id", F.lit(a)), F.lit(20_000)) - 10_000 for a in "xyz"}
    at = [F.coalesce(*(F.col(f"_{k}{a}") + far * spread[a] / 10_000 for k, (*_, far) in enumerate(steps)), spread[a] / 10.0)
        .alias(f"pos_{a}") for a in "xyz"]
    where = F.coalesce(*(F.when(F.col(f"_{k}x").isNotNull(), name) for k, (name, *_) in enumerate(steps)), F.lit("deterministic-global"))
    return j.select("id", *at, where.alias("provenance"))


def entities(communities: DataFrame, users: DataFrame, posts: DataFrame, comments: DataFrame, active: DataFrame) -> DataFrame:
    """id, label, type, value, and the ids of parent, author and community of every source row."""
    none = F.lit(None).cast("string")
    home = best_anchor(active).select(F.col("user_id").alias("id"), F.col("community_id").alias("home"))
    total = active.groupBy(F.col("user_id").alias("id")).agg(F.sum("activity_count").alias("total"))
    u = users.join(home, "id", "left").join(total, "id", "left")
    parent = F.when(F.col("parent_id").like("t1_%"), F.concat(F.lit("comment_"), F.expr("substring(parent_id, 4)"))).otherwise(F.concat(F.lit(
        "post_"), F.expr("substring(parent_id, 4)")))
    parts = [
        communities.select(typed_id("community", "id").alias("id"), label(F.col("name"), F.concat(F.lit("Community "), F.col("id")
            .cast("string"))).alias("label"), F.lit("community").alias("type"), F.col("subscribers").cast("long")
            .alias("value"), none.alias("parent_id"), none.alias("author_id"), typed_id("community", "id")
            .alias("community_id")),
        u.select(typed_id("user", "id").alias("id"), label(F.col("username"), F.concat(F.lit("User "), F.col("id")
            .cast("string"))).alias("label"), F.lit("user").alias("type"), F.coalesce("total", F.lit(0))
            .cast("long").alias("value"), none.alias("parent_id"), none.alias("author_id"), typed_id("community", "home")
            .alias("community_id")),
        posts.select(typed_id("post", "id").alias("id"), label(F.col("title"), F.concat(F.lit("Post "), F.col("id")
            .cast("string"))).alias("label"), F.lit("post").alias("type"), F.col("score").cast("long")
            .alias("value"), typed_id("community", "community_id").alias("parent_id"), typed_id("user", "author_id")
            .alias("author_id"), typed_id("community", "community_id").alias("community_id")),
        comments.select(typed_id("comment", "id").alias("id"), label(F.col("body"), F.concat(F.lit("Comment "), F.col("id")))
            .alias("label"), F.lit("comment").alias("type"), F.col("score").cast("long").alias("value"), parent.alias("parent_id"), typed_id(
            "user", "author_id").alias("author_id"), typed_id("community", "community_id").alias("community_id")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def structural_links(rows: DataFrame) -> DataFrame:
    """source, target and relation from the entities' own references, to entities that exist."""
    found = structural(rows)
    keys = rows.select(F.col("id"))
    return found.join(keys.withColumnRenamed("id", "source"), "source", "left_semi").join(keys.withColumnRenamed("id", "target"), "target",
        "left_semi").select("source", "target", "relation")


def quantiles(rows: DataFrame) -> DataFrame:
    """type and the 5th and 95th percentile of its values, nearest rank."""
    return rows.groupBy("type").agg(*(F.expr(f"percentile_disc({p}) within group (order by value)").cast("long")
        .alias(n) for n, p in (("low", 0.05), ("high", 0.95))))


def tombstoned(docs: DataFrame) -> DataFrame:
    """Texts of what is removed or deleted are gone."""
    gone = F.col("removed") | F.col("deleted")
    return docs.select("id", *(F.when(~gone, F.col(c)).alias(c) for c in ("title", "body")))


def validation(rows: DataFrame, expected: dict[str, int] | None = None, positions: DataFrame | None = None, documents: DataFrame | None = None) -> DataFrame:
    """One row of gates: numbers by type as expected, no empty labels, and what is given of the rest.

    positions (pos_x, pos_y, pos_z) must be finite, within 1e12, and not all the same on any
    axis; documents (id) must be of entities.
    """
    checks = [F.count("*").alias("n"), F.count_if(F.col("label") == "").alias("empty_labels"), *(F.count_if(F.col("type") == t)
        .alias(f"n_{t}") for t in ("community", "user", "post", "comment"))]
    found = rows.agg(*checks)
    ok = (F.col("empty_labels") == 0) & (F.col("n") > 0)
    for t, n in (expected or {}).items():
        ok = ok & (F.col(f"n_{t}") == n)
    if positions is not None:
        axes = [F.col(f"pos_{a}") for a in "xyz"]
        lost = F.count_if(reduce(lambda x, y: x | y, (a.isNull() | F.isnan(a) | (F.abs(a) > FARTHEST) for a in axes)))
        flat = reduce(lambda x, y: x | y, (F.min(a) >= F.max(a) for a in axes))
        found = found.crossJoin(positions.agg(lost.alias("bad_positions"), F.coalesce(flat, F.lit(True)).alias("collapsed")))  # one-row frames
        ok = ok & (F.col("bad_positions") == 0) & ~F.col("collapsed")
    if documents is not None:
        found = found.crossJoin(documents.join(rows.select("id"), "id", "left_anti").agg(F.count("*").alias("stray_documents")))
        ok = ok & (F.col("stray_documents") == 0)
    return found.withColumn("passed", ok)


def checksum(rows: DataFrame, name: str, watermark: str) -> DataFrame:
    """One row: sha-256 of the name, the watermark and the number of each type."""
    counts = rows.groupBy("type").agg(F.count("*").alias("n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("type", "n"))), lambda x: F.concat(x["type"], F.lit("="), x["n"].cast(
        "string"))), ",")
    return counts.agg(text.alias("counts")).select("counts", F.sha2(F.concat_ws(":", F.lit(name), F.lit(watermark), "counts"), 256).alias("checksum"))
