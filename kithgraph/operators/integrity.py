"""Checks that references hold, set operations, upserts and differences between versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kithgraph.plans.staging import staged


def orphan_posts(posts: DataFrame, communities: DataFrame, users: DataFrame) -> DataFrame:
    """Posts without their community or author."""
    c = posts.join(communities.select(F.col("id").alias("community_id")), "community_id", "left_anti").select("id")
    u = posts.join(users.select(F.col("id").alias("author_id")), "author_id", "left_anti").select("id")
    return c.union(u).distinct()


def orphan_comments(comments: DataFrame, posts: DataFrame, users: DataFrame) -> DataFrame:
    p = comments.join(posts.select(F.col("id").alias("post_id")), "post_id", "left_anti").select("id")
    u = comments.join(users.select(F.col("id").alias("author_id")), "author_id", "left_anti").select("id")
    return p.union(u).distinct()


def orphan_links(links: DataFrame, nodes: DataFrame) -> DataFrame:
    s = links.join(nodes.select(F.col("id").alias("source")), "source", "left_anti").select("source", "target")
    t = links.join(nodes.select(F.col("id").alias("target")), "target", "left_anti").select("source", "target")
    return s.union(t).distinct()


def orphan_nodes(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes without a link at either end."""
    ends = links.select(F.explode(F.array("source", "target")).alias("id"))
    return nodes.join(ends, "id", "left_anti").select("id", "type")


def lost_replies(comments: DataFrame) -> DataFrame:
    """Comments whose parent comment isn't there."""
    replies = comments.where(F.col("parent_id").like("t1_%")).withColumn("_parent", F.expr("substring(parent_id, 4)"))
    return replies.join(comments.select(F.col("id").alias("_parent")), "_parent", "left_anti").select("id", "parent_id")


def sound(rows: DataFrame, orphans: DataFrame, keys: list[str]) -> DataFrame:
    """What a delete of the orphans leaves."""
    return rows.join(orphans.select(*keys), keys, "left_anti")


def report(checks: dict[str, DataFrame]) -> DataFrame:
    """check, count and has_issues for each of the named checks."""
    out = None
    for name, found in checks.items():
        row = found.agg(F.count("*").alias("count")).select(F.lit(name).alias("check"), "count", (F.col("count") > 0).alias("has_issues"))
        out = row if out is None else out.unionByName(row)
    return out


def upserted(old: DataFrame, new: DataFrame, key: str, order: Column) -> DataFrame:
    """Last write wins by key: new rows before old ones, among new ones by order."""
    both = old.withColumns({"_new": F.lit(0), "_at": F.lit(0).cast("long")}).unionByName(new.withColumns({"_new": F.lit(1), "_at": order.cast(
        "long")}))
    w = Window.partitionBy(key).orderBy(F.desc("_new"), F.desc("_at"))
    return both.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank", "_new", "_at")


def insertable_links(batch: DataFrame, nodes: DataFrame, existing: DataFrame) -> DataFrame:
    """Different links of a batch whose ends exist and that are not there yet."""
    found = batch.select("source", "target").distinct().join(nodes.select(F.col("id").alias("source")), "source", "left_semi")
    return found.join(nodes.select(F.col("id").alias("target")), "target", "left_semi").select("source", "target").join(existing, ["source",
        "target"], "left_anti")


def moved(nodes: DataFrame, positions: DataFrame, least: float) -> DataFrame:
    """Nodes with new positions, except for moves below the least distance."""
    new = positions.select("id", *(F.col(f"pos_{a}").alias(f"_{a}") for a in "xyz"))
    joined = nodes.join(new, "id", "left")
    d2 = sum(((F.col(f"_{a}") - F.col(f"pos_{a}")) ** 2 for a in "xyz"), F.lit(0.0))
    stay = F.col("_x").isNull() | (F.coalesce(d2, F.lit(float("inf"))) < least * least)
    return joined.select(*(F.when(stay, F.col(c)).otherwise(F.col(f"_{c[-1]}")).alias(c) if c.startswith("pos_") else F.col(c) for c in nodes.columns))


def one_sided(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """action and key of rows that only one of two versions has."""
    a, b = old.select(F.col(key).alias("_old")), new.select(F.col(key).alias("_new"))
    both = a.join(b, F.col("_old") == F.col("_new"), "full_outer").where("_old is null or _new is null")
    return both.select(F.when(F.col("_old").isNull(), "add").otherwise("remove").alias("action"), F.coalesce("_old", "_new").alias(key))


def snapshot_diff(old: DataFrame, new: DataFrame, least: float = 1e-4) -> DataFrame:
    """add, remove and update between two versions of nodes (id, val, pos_x, pos_y, pos_z)."""
    o = old.select("id", *(F.col(c).alias(f"o_{c}") for c in ("val", "pos_x", "pos_y", "pos_z")), F.lit(True).alias("o"))
    n = new.select("id", *(F.col(c).alias(f"n_{c}") for c in ("val", "pos_x", "pos_y", "pos_z")), F.lit(True).alias("n"))
    same = F.col("o_val").eqNullSafe(F.col("n_val"))
    for a in "xyz":
        x, y = F.col(f"o_pos_{a}"), F.col(f"n_pos_{a}")
        same = same & (x.isNull() == y.isNull()) & F.coalesce(F.abs(x - y) < least, F.lit(True))
    action = F.when(F.col("o").isNull(), "add").when(F.col("n").isNull(), "remove").when(~same, "update")
    return o.join(n, "id", "full_outer").select(action.alias("action"), "id").where("action is not null")


def link_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """add and remove of links (source, target) between two versions, by source->target."""
    ends = [x.select(F.concat_ws("->", "source", "target").alias("id")).distinct() for x in (old, new)]
    return one_sided(*ends, "id")


def full_diff(old: tuple[DataFrame, DataFrame] | None, new: tuple[DataFrame, DataFrame], least: float = 1e-4) -> DataFrame:
    """entity_type, action and id of all changes of nodes and links; everything is added to a first version."""
    if old is None:
        old = tuple(x.limit(0) for x in new)
    nodes = snapshot_diff(old[0], new[0], least).select(F.lit("node").alias("entity_type"), "action", "id")
    return nodes.unionByName(link_diff(old[1], new[1]).select(F.lit("link").alias("entity_type"), "action", "id"))


def deleted_in_batches(rows: DataFrame, orphans: DataFrame, keys: list[str], batch: int) -> tuple[DataFrame, DataFrame]:
    """What one batch of a delete takes, in the order of the keys, and what it leaves.

    A batch may be a large part of all rows, so it is cut by a number of its own parts' order, not by a limit, which one task would take.
    """
    # Rows that stay and rows that may go come from one join, so both are known after one shuffle of all rows.
    known = orphans.select(*keys).distinct().withColumn("_gone", F.lit(True))
    both = staged(rows.join(known, keys, "left").withColumn("_gone", F.col("_gone").isNotNull()), "deletable")
    gone, rest = (both.where(x).select(*rows.columns) for x in ("_gone", "not _gone"))
    if gone.count() <= batch:
        return gone, rest
    at = F.monotonically_increasing_id()  # the part, shifted by 33 bits, and the place in it
    gone = staged(gone.orderBy(*keys).withColumn("_at", at), "deletable")
    left, end = batch, 0
    for part, n in sorted(gone.groupBy(F.shiftright("_at", 33).alias("part")).count().collect()):  # one row for each part
        end = (part << 33) + min(n, left)
        left -= min(n, left)
        if not left:
            break
    return gone.where(F.col("_at") < end).drop("_at"), rest.unionByName(gone.where(F.col("_at") >= end).drop("_at"))


def identity_events(shared: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Merges, splits, new and retired groups, of the overlaps (new_id, old_id) between two builds."""
    ids = F.array_sort(F.collect_list("old_id")), F.array_sort(F.collect_list("new_id"))
    merge = shared.groupBy("new_id").agg(ids[0].alias("old_ids")).where(F.size("old_ids") > 1).select(F.lit("merge")
        .alias("event"), "old_ids", F.array("new_id").alias("new_ids"))
    split = shared.groupBy("old_id").agg(ids[1].alias("new_ids")).where(F.size("new_ids") > 1).select(F.lit("split")
        .alias("event"), F.array("old_id").alias("old_ids"), "new_ids")
    none = F.array().cast("array<bigint>")
    born = new.join(shared, "new_id", "left_anti").select(F.lit("new").alias("event"), none.alias("old_ids"), F.array("new_id").alias("new_ids"))
    gone = old.join(shared, "old_id", "left_anti").select(F.lit("retired").alias("event"), F.array("old_id").alias("old_ids"), none.alias("new_ids"))
    return merge.unionByName(split).unionByName(born).unionByName(gone)
