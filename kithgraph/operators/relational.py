"""Activity, overlap, joins, induced subgraphs and counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithgraph.functions.columns import by_weight, effective_time, typed_id, weight


def activity(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """user_id, community_id and activity_count: what each user wrote in each community."""
    names = [F.col("author_id").alias("user_id"), "community_id"]
    wrote = posts.select(*names).unionByName(comments.select(*names)).where("user_id is not null and community_id is not null")
    return wrote.groupBy("user_id", "community_id").agg(F.count("*").alias("activity_count"))


def overlap_pairs(active: DataFrame) -> DataFrame:
    """u < v and the users active in both; one shuffle by user, then partial sums by pair."""
    a = active.select("user_id", F.col("community_id").alias("u"))
    b = active.select("user_id", F.col("community_id").alias("v"))
    return a.join(b, "user_id").where("u < v").groupBy("u", "v").agg(F.count("*").alias("overlap_count"))


def overlaps(active: DataFrame, least: int = 1) -> DataFrame:
    """source, target and overlap_count in both directions; the self-join runs once."""
    one = overlap_pairs(active).where(F.col("overlap_count") >= least)
    both = F.explode(F.array(F.struct(F.col("u").alias("source"), F.col("v").alias("target")), F.struct(F.col("v")
        .alias("source"), F.col("u").alias("target"))))
    return one.select(both.alias("d"), "overlap_count").select("d.source", "d.target", "overlap_count")


def overlap_of(active: DataFrame, a: int, b: int) -> DataFrame:
    """overlap_count of two communities."""
    one = active.where(F.col("community_id") == a).select("user_id").distinct()
    two = active.where(F.col("community_id") == b).select("user_id").distinct()
    return one.join(two, "user_id", "left_semi").agg(F.count("*").alias("overlap_count"))


def users_with_activity(users: DataFrame, posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Every user with the number of posts and comments, aggregated before the join."""
    p = posts.groupBy("author_id").agg(F.count("*").alias("n_posts")).withColumnRenamed("author_id", "id")
    c = comments.groupBy("author_id").agg(F.count("*").alias("n_comments")).withColumnRenamed("author_id", "id")
    total = (F.coalesce("n_posts", F.lit(0)) + F.coalesce("n_comments", F.lit(0))).alias("total_activity")
    return users.join(p, "id", "left").join(c, "id", "left").select("id", "username", total)


def user_activity_since(users: DataFrame, posts: DataFrame, comments: DataFrame, since: str) -> DataFrame:
    """The same over rows after a time, for users with any."""
    late = F.col("created_at") > F.lit(since).cast("timestamp")
    return users_with_activity(users, posts.where(late), comments.where(late)).where("total_activity > 0")


def user_communities(communities: DataFrame, posts: DataFrame, comments: DataFrame, user: int) -> DataFrame:
    """Communities in which a user wrote."""
    mine = F.col("author_id") == user
    ids = posts.where(mine).select("community_id").union(comments.where(mine).select("community_id")).distinct()
    return communities.join(ids, F.col("id") == F.col("community_id"), "left_semi").select("id", "name")


def links_among(links: DataFrame, ids: DataFrame, most: int | None = None) -> DataFrame:
    """Links with both ends among ids (id), in the order of their ends where capped."""
    found = links.join(ids.select(F.col("id").alias("source")), "source", "left_semi").join(ids.select(F.col("id")
        .alias("target")), "target", "left_semi").select("source", "target")
    return found if most is None else found.orderBy("source", "target").limit(most)


def top_nodes(nodes: DataFrame, most: int) -> DataFrame:
    """The heaviest nodes."""
    return nodes.orderBy(*by_weight()).limit(most)


def tagged(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes and links in one table, with data_type telling which."""
    n = nodes.select(F.lit("node").alias("data_type"), "id", "name", "val", "type")
    l_ = links.select(F.lit("link").alias("data_type"), F.concat_ws("->", "source", "target").alias("id"), "source", "target")
    return n.unionByName(l_, allowMissingColumns=True)


def capped_graph(nodes: DataFrame, links: DataFrame, most_nodes: int, most_links: int, types: list[str] | None = None) -> DataFrame:
    """The heaviest nodes (of some types) and the links among them.

    most_nodes bounds what the semi-joins hold, so AQE broadcasts the node ids when small enough.
    """
    kept = top_nodes(nodes if types is None else nodes.where(F.col("type").isin(*types)), most_nodes)
    return tagged(kept, links_among(links, kept, most_links))


def full_graph(nodes: DataFrame, links: DataFrame) -> DataFrame:
    return tagged(nodes, links)


def degrees(links: DataFrame) -> DataFrame:
    """id and the number of link ends at it."""
    return links.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def cap_graph(nodes: DataFrame, links: DataFrame, most_nodes: int, most_links: int) -> DataFrame:
    """Ranked anew by the larger of weight and degree."""
    ranked = nodes.join(degrees(links), "id", "left").withColumn("rank_value", F.greatest(weight(), F.coalesce("degree", F.lit(0))))
    kept = ranked.orderBy(F.desc("rank_value"), "id").limit(most_nodes)
    return tagged(kept, links_among(links, kept, most_links))


def neighbours(nodes: DataFrame, links: DataFrame, node: str, most: int) -> DataFrame:
    """Neighbours of a node with the number of links to each."""
    out = links.where(F.col("source") == node).select(F.col("target").alias("id"))
    back = links.where(F.col("target") == node).select(F.col("source").alias("id"))
    counts = out.unionByName(back).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.join(counts, "id").select("id", "name", "val", "type", "degree").orderBy(F.desc("degree"), "id").limit(most)


def reciprocal(relationships: DataFrame) -> DataFrame:
    """One row for each undirected pair, with the larger weight of both directions."""
    r = relationships.select(F.col("target").alias("source"), F.col("source").alias("target"), F.col("overlap_count").alias("back"))
    joined = relationships.join(r, ["source", "target"], "left").where((F.col("source") < F.col("target")) | F.col("back").isNull())
    return joined.select(F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v"), F.greatest("overlap_count", F.coalesce(
        "back", F.lit(0))).alias("weight"))


def overlap_projection(relationships: DataFrame) -> DataFrame:
    """The largest overlap of each canonical pair."""
    return relationships.groupBy(F.least("source", "target").alias("u"), F.greatest("source", "target")
        .alias("v")).agg(F.max("overlap_count").alias("weight"))


def workspace_links(active: DataFrame, relationships: DataFrame, nodes: DataFrame, existing: DataFrame, cap: int) -> DataFrame:
    """The strongest links by weight whose ends are nodes and that are not there yet; the anti-join stays outside the cap."""
    order = [F.desc("weight"), "source", "target"]
    a = active.select(typed_id("user", "user_id").alias("source"), typed_id("community", "community_id")
        .alias("target"), F.col("activity_count").alias("weight"))
    b = relationships.select(typed_id("community", "source").alias("source"), typed_id("community", "target")
        .alias("target"), F.col("overlap_count").alias("weight"))
    both = [x.join(nodes.select(F.col("id").alias("source")), "source", "left_semi").join(nodes.select(F.col("id")
        .alias("target")), "target", "left_semi").select("source", "target", "weight").orderBy(*order)
        .limit(cap) for x in (a, b)]
    return both[0].unionByName(both[1]).orderBy(*order).limit(cap).join(existing.select("source", "target"), ["source", "target"], "left_anti")


def changed_since(rows: DataFrame, since: str, times: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """Rows with any of the times (created, updated) after a time."""
    after = [F.col(c) > F.lit(since).cast("timestamp") for c in times]
    return rows.where(F.coalesce(reduce(lambda a, b: a | b, after), F.lit(False)))


def stale(rows: dict[str, DataFrame], now: str, days: int) -> DataFrame:
    """type, id and days since, of rows (id, last_seen) of all kinds that were not seen for so many days."""
    end = F.lit(now).cast("timestamp")
    age = ((F.unix_timestamp(end) - F.unix_timestamp("last_seen")) / 86400).cast("int")
    old = F.col("last_seen") < end - F.make_dt_interval(days=F.lit(days))
    parts = [r.where(old).select(F.lit(kind).alias("type"), F.col("id").cast("string").alias("id"), age.alias("days")) for kind, r in rows.items()]
    return reduce(DataFrame.unionByName, parts)


def at_watermark(rows: DataFrame, watermark: str) -> DataFrame:
    """Rows whose effective time isn't after the watermark."""
    return rows.where(effective_time(F.lit(None).cast("timestamp"), F.col("created_at")) <= F.lit(watermark).cast("timestamp"))


def source_watermark(*tables: DataFrame) -> DataFrame:
    """The latest time in any of the tables, the epoch without rows; one row."""
    from kithgraph.functions.columns import epoch

    latest = [t.agg(F.max("created_at").alias("at")) for t in tables]
    all_ = latest[0]
    for t in latest[1:]:
        all_ = all_.unionByName(t)
    return all_.agg(F.coalesce(F.max("at"), epoch()).alias("watermark"))


def author_cross_links(posts: DataFrame, cap: int) -> DataFrame:
    """Each post with at most cap posts of its author in other communities, the smallest ids first.

    Only an author's first 2 * cap posts can be wanted, of which no community has more than
    cap: without any one community, cap of them or all others are left. So a post meets a
    bounded number of others, however many its author wrote.
    """
    from pyspark.sql import Window

    a = posts.select("author_id", F.col("id").alias("source"), F.col("community_id").alias("c"))
    b = posts.select("author_id", F.col("id").alias("target"), F.col("community_id").alias("d")).where("author_id is not null")
    few = b.withColumn("k", F.row_number().over(Window.partitionBy("author_id", "d").orderBy("target"))).where(F.col("k") <= cap)
    few = few.withColumn("k", F.row_number().over(Window.partitionBy("author_id").orderBy("target"))).where(F.col("k") <= 2 * cap).drop("k")
    ranked = a.join(few, "author_id").where("c <> d").withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy("target")))
    return ranked.where(F.col("k") <= cap).select(typed_id("post", "source").alias("source"), typed_id("post", "target").alias("target"))


def detailed_content(posts: DataFrame, comments: DataFrame, most_posts: int, most_comments: int) -> DataFrame:
    """Links of each community's newest posts and of each such post's first comments."""
    from pyspark.sql import Window

    newest = Window.partitionBy("community_id").orderBy(F.desc("created_at"), F.asc("id"))
    some = posts.withColumn("k", F.row_number().over(newest)).where(F.col("k") <= most_posts)
    first = Window.partitionBy("post_id").orderBy("depth", "id")
    said = comments.join(some.select(F.col("id").alias("post_id")), "post_id", "left_semi").withColumn("k", F.row_number()
        .over(first)).where(F.col("k") <= most_comments)
    parts = [
        some.select(typed_id("community", "community_id").alias("source"), typed_id("post", "id").alias("target"), F.lit("published")
            .alias("relation")),
        some.select(typed_id("user", "author_id").alias("source"), typed_id("post", "id").alias("target"), F.lit("wrote").alias("relation")),
        said.select(typed_id("post", "post_id").alias("source"), typed_id("comment", "id").alias("target"), F.lit("comment").alias("relation")),
        said.select(typed_id("user", "author_id").alias("source"), typed_id("comment", "id").alias("target"), F.lit("wrote").alias("relation")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
