"""Reads around one entity or group: details, neighbourhoods, community trees, macro groups, and the legacy document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithgraph.functions.columns import path_segment, typed_id
from kithgraph.operators.spatial import visible

#: Before all weights.
FIRST = (1 << 63) - 1
_REFS = ("parent_id", "author_id")


def adjacent(entities: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """neighbour and weight, a row for each way in which an entity is next to another.

    Stored links (source, target, weight) either way, what the entity names as parent and
    author (each once), and entities that name it.
    """
    out = links.where(F.col("source") == key).select(F.col("target").alias("neighbour"), "weight")
    back = links.where(F.col("target") == key).select(F.col("source").alias("neighbour"), "weight")
    one = F.lit(1).cast("long").alias("weight")
    named = F.explode(F.array_distinct(F.array_compact(F.array(*_REFS)))).alias("neighbour")
    mine = entities.where(F.col("id") == key).select(named, one)
    naming = F.lit(False)
    for c in _REFS:
        naming = naming | F.coalesce(F.col(c) == key, F.lit(False))
    theirs = entities.where(naming).select(F.col("id").alias("neighbour"), one)
    return out.unionByName(back).unionByName(mine).unionByName(theirs)


def neighbourhood(entities: DataFrame, links: DataFrame, suppressed: DataFrame, key: str, most: int) -> DataFrame:
    """id, priority, type and value of an entity and what is next to it: itself first, then by the strongest link."""
    near = adjacent(entities, links, key).where(F.col("neighbour") != key).groupBy(F.col("neighbour")
        .alias("id")).agg(F.max("weight").alias("priority"))
    me = entities.where(F.col("id") == key).select("id", F.lit(FIRST).alias("priority"))
    chosen = me.unionByName(near).orderBy(F.desc("priority"), "id").limit(most)
    found = visible(entities.select("id", "type", "value"), suppressed).join(chosen, "id")
    return found.select("id", "priority", "type", "value").orderBy(F.desc("priority"), F.desc("value"), "id")


def details(entities: DataFrame, documents: DataFrame, communities: DataFrame, suppressed: DataFrame, key: str) -> DataFrame:
    """One row about a visible entity, else about the community of that id, with its document and its community's evidence.

    documents: id, title, body, source_sensitive, administrative_sensitive. communities: id,
    label, size, macro_group_id, distinctiveness, confidence. Texts of sensitive entities are left out.
    """
    c = communities.select(F.col("id").alias("community_id"), "macro_group_id", "distinctiveness", "confidence")
    mine = visible(entities.where(F.col("id") == key), suppressed)
    doc = documents.where(F.col("id") == key)
    j = mine.join(doc, "id", "left").join(c, "community_id", "left")
    sensitive = F.coalesce(F.col("source_sensitive") | F.col("administrative_sensitive"), F.lit(False))
    whole = j.select(
        "id", F.col("label").alias("name"), F.col("value").cast("long").alias("value"), "type", "community_id", "macro_group_id",
        F.coalesce("distinctiveness", F.lit(0.0)).alias("distinctiveness"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.when(~sensitive, F.col("title")).alias("title"), F.when(~sensitive, F.col("body")).alias("body"), sensitive.alias("sensitive"),
        F.concat(F.lit("/catalog/"), F.col("type"), F.lit("s/"), path_segment(F.col("id"))).alias("page"),
    )
    group = visible(communities.where(F.col("id") == key), suppressed).join(mine.select("id"), "id", "left_anti")
    none = F.lit(None).cast("string")
    other = group.select(
        "id", F.col("label").alias("name"), F.col("size").cast("long").alias("value"), F.lit("cluster").alias("type"), F.col("id").alias(
            "community_id"), "macro_group_id",
        "distinctiveness", "confidence", F.col("label").alias("title"), none.alias("body"), F.lit(False).alias("sensitive"),
        F.concat(F.lit("/catalog/clusters/"), path_segment(F.col("id"))).alias("page"),
    )
    return whole.unionByName(other)


def close_entities(entities: DataFrame, links: DataFrame, suppressed: DataFrame, key: str, most: int) -> DataFrame:
    """id, label, value, type and degree of the neighbours that are next to an entity in most ways; degree counts the ways."""
    ranked = adjacent(entities, links, key).groupBy(F.col("neighbour").alias("id")).agg(F.count("*").alias("degree")).orderBy(F.desc(
        "degree"), "id").limit(most)
    found = visible(entities.select("id", "label", "value", "type"), suppressed).join(ranked, "id")
    return found.orderBy(F.desc("degree"), F.desc("value"), "id")


def legacy_details(nodes: DataFrame, links: DataFrame, communities: DataFrame, key: str, most: int = 10) -> DataFrame:
    """One row: a node with its top neighbours as text, how many are told, its true degree, and a community's subscribers by name."""
    out = links.where(F.col("source") == key).select(F.col("target").alias("id"))
    back = links.where(F.col("target") == key).select(F.col("source").alias("id"))
    around = out.unionByName(back).groupBy("id").agg(F.count("*").alias("links"))
    top = nodes.select("id").join(around, "id").orderBy(F.desc("links"), "id").limit(most)
    told = top.agg(
        F.count("*").alias("degree"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("links")).alias("n"), "id"))), lambda x: F.concat(x["id"], F.lit(
            ":"), (-x["n"]).cast("string"))), ",").alias("neighbours"),
    )
    total = around.agg(F.coalesce(F.sum("links"), F.lit(0)).alias("true_degree"))
    mine = nodes.where(F.col("id") == key).crossJoin(F.broadcast(told)).crossJoin(F.broadcast(total))  # one row each
    stats = communities.select(F.lit("community").alias("type"), "name", "subscribers")
    return mine.join(stats, ["type", "name"], "left").select("id", "name", "val", "type", "degree", "true_degree", "neighbours", "subscribers")


def community_tree(entities: DataFrame, suppressed: DataFrame, root: str, most: int, start: int = 0) -> DataFrame:
    """A page of what lies under a root: a community's own members, else children; with author and number of visible children.

    entities: id, type, label, value, parent_id, author_id, cluster_id (of communities). Roots
    that are clusters hold communities, all others what names them as parent.
    """
    shown = visible(entities, suppressed)
    under = (F.col("parent_id") == root) | ((F.col("cluster_id") == root) & (F.col("type") == "community"))
    children = shown.where(F.coalesce(under, F.lit(False)))
    counts = shown.groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("child_count"))
    page = children.orderBy(F.desc("value"), "id").offset(start).limit(most)
    return page.join(counts, "id", "left").select("id", "type", "label", "value", "author_id", F.coalesce("child_count", F.lit(0))
        .alias("child_count")).orderBy(F.desc("value"), "id")


def cross_linked_authors(page: DataFrame) -> DataFrame:
    """One row: the authors on a page of a tree, in order."""
    return page.agg(F.array_join(F.array_sort(F.collect_set("author_id")), ",").alias("authors"))


def macro_groups(communities: DataFrame, routes: DataFrame, suppressed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Visible macro groups by palette role, and the links between visible ones by affinity.

    communities: id, macro_group_id, role, size, distinctiveness, confidence. routes between
    communities: source, target, affinity, evidence.
    """
    by = communities.groupBy(F.col("macro_group_id").alias("id")).agg(F.min("role").alias("role"), F.count("*")
        .alias("communities"), F.sum("size").cast("long").alias("members"))
    shown = visible(by, suppressed)
    a, b = (communities.select(F.col("id").alias(c), F.col("macro_group_id").alias(f"g{c}")) for c in ("source", "target"))
    across = routes.join(a, "source").join(b, "target").where("gsource <> gtarget")
    links = across.groupBy(F.least("gsource", "gtarget").alias("source"), F.greatest("gsource", "gtarget").alias("target"))
    links = links.agg(F.least(F.lit(1.0), F.avg("affinity")).alias("affinity"), F.sum("evidence").alias("evidence"))
    for end in ("source", "target"):
        links = links.join(shown.select(F.col("id").alias(end)), end, "left_semi")
    return shown.orderBy("role", "id"), links.orderBy(F.desc("affinity"), "source", "target")


def legacy_graph(communities: DataFrame, users: DataFrame, active: DataFrame, relationships: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (communities by subscribers, users by what they wrote) and links of the legacy document."""
    total = active.groupBy(F.col("user_id").alias("id")).agg(F.sum("activity_count").alias("total"))
    nodes = communities.select(typed_id("community", "id").alias("id"), "name", F.col("subscribers").cast("string").alias("val"), F.lit("community").alias("type")).unionByName(
        users.join(total, "id", "left").select(typed_id("user", "id").alias("id"), F.col("username").alias("name"), F.coalesce("total", F.lit(
            0)).cast("string").alias("val"), F.lit("user").alias("type"))
    )
    links = relationships.where("overlap_count > 0").select(typed_id("community", "source").alias("source"), typed_id("community", "target").alias("target")).unionByName(
        active.where("activity_count > 0").select(typed_id("user", "user_id").alias("source"), typed_id("community", "community_id").alias("target"))
    )
    return nodes, links


class Gone(LookupError):
    """A version that retention has dropped."""


def version_diff(diffs: DataFrame, versions: DataFrame, since: int) -> DataFrame:
    """entity_type, action and n of all changes after a version; raises Gone for one that is no longer kept.

    diffs: version_id, entity_type, action. versions: id, status.
    """
    done = versions.where(F.col("status") == "completed")
    low, high = done.agg(F.min("id"), F.max("id")).first()
    if low is None or since < low - 1:
        raise Gone(f"version {since} is no longer kept; the oldest is {low}")
    if since > high:
        raise ValueError(f"version {since} is not yet there; the current one is {high}")
    after = done.where(F.col("id") > since).select(F.col("id").alias("version_id"))
    return diffs.join(after, "version_id", "left_semi").groupBy("entity_type", "action").agg(F.count("*").alias("n"))
