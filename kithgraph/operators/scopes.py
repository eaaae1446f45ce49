"""Bounded reads of a revision: overviews, pages, scenes, details and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithgraph.operators.ranking import first_by
from kithgraph.operators.relational import degrees, links_among, tagged
from kithgraph.operators.spatial import AXES, visible


def community_subgraph(nodes: DataFrame, links: DataFrame, members: DataFrame, most: int) -> DataFrame:
    """Members (id) of a community and the links among them; links sort before nodes, and the limit holds for both."""
    kept = nodes.join(members.select("id"), "id", "left_semi")
    return tagged(kept, links_among(links, kept)).orderBy("data_type", "id").limit(most)


def communities_page(landmarks: DataFrame, size: int, start: int) -> DataFrame:
    """A page of communities by size, each row with the total."""
    total = landmarks.agg(F.count("*").alias("total"))
    return landmarks.orderBy(F.desc("size"), "id").offset(start).limit(size).crossJoin(F.broadcast(total))  # total: one row


def overview(landmarks: DataFrame, routes: DataFrame, most_nodes: int, most_links: int) -> DataFrame:
    """The first landmarks (id, overview_rank) and the strongest routes (source, target, affinity, weight) among them."""
    kept = landmarks.orderBy("overview_rank", "id").limit(most_nodes).select("id")
    among = routes.join(kept.withColumnRenamed("id", "source"), "source", "left_semi").join(kept.withColumnRenamed("id", "target"), "target",
        "left_semi")
    among = among.orderBy(F.desc("affinity"), F.desc("weight"), "source", "target").limit(most_links)
    n = kept.select(F.lit("node").alias("data_type"), F.col("id").cast("string").alias("id"))
    return n.unionByName(among.select(F.lit("link").alias("data_type"), F.concat_ws("->", F.col("source")
        .cast("string"), F.col("target").cast("string")).alias("id")))


def community_scene(entities: DataFrame, suppressed: DataFrame, community: str, kinds: list[str], most: int) -> DataFrame:
    """Visible entities of a community by value."""
    mine = entities.where((F.col("community_id") == community) & F.col("type").isin(*kinds))
    return visible(mine, suppressed).select("id", "label", "type", "value").orderBy(F.desc("value"), "id").limit(most)


def entity_system(entities: DataFrame, community: str, most: int) -> DataFrame:
    """A page of a community's posts and their authors."""
    posts = entities.where((F.col("community_id") == community) & (F.col("type") == "post")).orderBy(F.desc("value"), "id").limit(most)
    ids = posts.select("id").union(posts.select("author_id")).distinct()
    return entities.join(ids, "id", "left_semi").select("id", "type", "value")


def references(entities: DataFrame, key: str) -> DataFrame:
    """The entities that an entity names as parent, author or community."""
    named = F.explode(F.array_distinct(F.array_compact(F.array("parent_id", "author_id", "community_id"))))
    ids = entities.where(F.col("id") == key).select(named.alias("id"))
    return entities.join(ids, "id", "left_semi").select("id", "type")


def node_details(entities: DataFrame, links: DataFrame, key: str, most: int) -> DataFrame:
    """The neighbours of an entity by their own degree, with that degree and the entity's true one."""
    around = links.where(F.col("source") == key).select(F.col("target").alias("id")).union(links.where(F.col("target") == key)
        .select(F.col("source").alias("id"))).distinct()
    own = degrees(links.where((F.col("source") == key) | (F.col("target") == key))).where(F.col("id") == key).select(F.col("degree")
        .alias("entity_degree"))
    found = degrees(links).join(around, "id", "left_semi").join(entities.select("id", "label"), "id").crossJoin(F.broadcast(own))  # own: one row
    return found.orderBy(F.desc("degree"), "id").limit(most)


def entity_pages(docs: DataFrame, most: int = 320) -> DataFrame:
    """id, heading and summary of public pages; sensitive ones show neither."""
    return docs.select("id", F.when(~F.col("sensitive"), F.col("title")).alias("heading"), F.when(~F.col("sensitive"), F.left(F.regexp_replace(
        "body", r"\s+", " "), F.lit(most))).alias("summary"))


def sensitivity(docs: DataFrame) -> DataFrame:
    """id, whether it is sensitive, and by whose word, of docs (id, source_sensitive, administrative_sensitive)."""
    why = F.array_compact(F.array(F.when(F.col("source_sensitive"), F.lit("source")), F.when(F.col("administrative_sensitive"), F.lit(
        "administrative"))))
    return docs.select("id", (F.col("source_sensitive") | F.col("administrative_sensitive")).alias("sensitive"), F.array_join(why, ",")
        .alias("sources"))


def telemetry(entities: DataFrame, links: DataFrame, suppressed: DataFrame) -> DataFrame:
    """One row of exact totals without suppressed entities and links at them."""
    seen = visible(entities, suppressed)
    keys = suppressed.where("restored_at is null").select(F.col("entity_id"))
    held = links.join(keys.withColumnRenamed("entity_id", "source"), "source", "left_anti").join(keys.withColumnRenamed("entity_id",
        "target"), "target", "left_anti")
    totals = seen.agg(F.count("*").alias("entities"), *(F.count_if(F.col("type") == t).alias(f"n_{t}") for t in ("community", "user", "post",
        "comment")))
    return totals.crossJoin(held.agg(F.count("*").alias("links")))  # one-row frames


def manifest(revision: DataFrame, levels: DataFrame, quantiles: DataFrame) -> DataFrame:
    """One row: a revision's fields with its levels and its quantiles by type."""
    l_ = levels.agg(F.array_join(F.transform(F.array_sort(F.collect_set("level")), lambda x: x.cast("string")), ",").alias("levels"))
    q = quantiles.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", F.struct("low", "high")))))).alias("quantiles"))
    return revision.crossJoin(l_).crossJoin(q)  # one-row frames


def level_summary(hierarchy: DataFrame, positions: DataFrame, level: int) -> DataFrame:
    """Communities of a level with their size and centroid."""
    mine = hierarchy.where(F.col("level") == level).join(positions, "id")
    return mine.groupBy("community_id").agg(F.count("*").alias("size"), *(F.avg(c).alias(c) for c in AXES))


def sitemap_tiers(entities: DataFrame, suppressed: DataFrame, most: int) -> DataFrame:
    """id and tier: communities; the heaviest users and posts; everything else that is visible."""
    seen = visible(entities, suppressed).select("id", "type", "value")
    top = seen.where(F.col("type").isin("user", "post")).orderBy(F.desc("value"), "id").limit(most).select("id", F.lit(2).alias("top"))
    tier = F.when(F.col("type") == "community", 1).otherwise(F.coalesce("top", F.lit(3)))
    return seen.join(top, "id", "left").select("id", tier.alias("tier"))


def diffs_since(diffs: DataFrame, versions: DataFrame, version: int) -> DataFrame:
    """Counts by action of the completed versions after one."""
    done = versions.where((F.col("status") == "completed") & (F.col("id") > version)).select(F.col("id").alias("version_id"))
    return diffs.join(done, "version_id").groupBy("version_id", "action").agg(F.count("*").alias("n"))


def representative_members(members: DataFrame, generic: DataFrame, most: int = 12) -> DataFrame:
    """The most telling members (group_id, id, name, strength) of each group: strength over the largest, names in generic count half."""
    peak = members.groupBy("group_id").agg(F.max("strength").alias("peak"))
    listed = generic.select(F.lower("name").alias("_name"), F.lit(True).alias("listed"))
    joined = members.join(peak, "group_id").withColumn("_name", F.lower("name")).join(listed, "_name", "left")
    base = 0.4 * F.col("strength") / F.greatest("peak", F.lit(1e-12)) + 0.3 * 0.5 + 0.2 * 0.7 + 0.1 * F.when(F.col("listed"), 0.0).otherwise(1.0)
    scored = joined.withColumn("score", base * F.when(F.col("listed"), 0.5).otherwise(1.0))
    return first_by(scored, ["group_id"], [F.desc("score"), F.asc("id")], most).select("group_id", "id", "score")


def labels(evidence: DataFrame, most: int = 3) -> DataFrame:
    """group_id, label and fingerprint of ranked topics (group_id, token, rank): title-cased, and unique by a suffix."""
    from pyspark.sql import Window

    named = F.array_sort(F.collect_list(F.struct("rank", "token")))
    by = evidence.groupBy("group_id").agg(named.alias("topics"))
    words = F.transform("topics", lambda t: t["token"])
    by = by.select("group_id", F.array_join(F.transform(F.slice(words, 1, most), F.initcap), " · ").alias("base"), F.sha2(F.array_join(F.array_sort(
        F.transform(words, F.lower)), "|"), 256).alias("fingerprint"))
    by = by.withColumn("base", F.when(F.col("base") == "", "Community").otherwise(F.col("base")))
    k = F.row_number().over(Window.partitionBy("base").orderBy("group_id"))
    return by.withColumn("_k", k).select("group_id", F.when(F.col("_k") == 1, F.col("base")).otherwise(F.concat("base", F.lit(" "), F.col(
        "_k").cast("string"))).alias("label"), "fingerprint")


def cached_labels(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Labels from a cache (fingerprint, label) where it has them, else the fallback, and whether it had."""
    j = wanted.join(cache.select("fingerprint", F.col("label").alias("_cached")), "fingerprint", "left")
    return j.select("group_id", F.coalesce("_cached", "label").alias("label"), F.col("_cached").isNotNull().alias("hit"))
