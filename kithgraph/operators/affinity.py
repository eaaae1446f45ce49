"""Hub-corrected affinity between communities, as expressions over pre-aggregated evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kithgraph.functions.columns import is_bridge
from kithgraph.plans.staging import staged

#: The layers of evidence and their weights.
LAYERS = {"active": 0.60, "authors": 0.20, "repeat": 0.10, "cross": 0.10}
#: Observations at which evidence counts half.
SHRINK = 5.0


def candidates(relationships: DataFrame, cross: DataFrame, least: int = 2) -> DataFrame:
    """u < v: pairs with enough overlap, or with a cross reference."""
    a = relationships.where(F.col("overlap_count") >= least).select(F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v"))
    b = cross.select(F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v"))
    return a.union(b).where("u <> v").distinct()


def marginals(active: DataFrame, posts: DataFrame, cross: DataFrame) -> DataFrame:
    """id and, for each layer, the community's total."""
    a = active.groupBy(F.col("community_id").alias("id")).agg(F.count("*").alias("m_active"), F.sum(F.least("activity_count", F.lit(100)))
        .alias("m_repeat"))
    p = posts.groupBy(F.col("community_id").alias("id")).agg(F.count_distinct("author_id").alias("m_authors"))
    c = cross.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("m_cross"))
    found = a.join(p, "id", "full_outer").join(c, "id", "full_outer")
    return found.select("id", *(F.coalesce(f"m_{k}", F.lit(0)).cast("long").alias(f"m_{k}") for k in LAYERS))


def totals(active: DataFrame, posts: DataFrame, cross: DataFrame) -> DataFrame:
    """One row: the universe of each layer."""
    a = active.agg(F.count_distinct("user_id").alias("t_active"), F.coalesce(F.sum(F.least("activity_count", F.lit(100))), F.lit(0))
        .alias("t_repeat"))
    return a.crossJoin(posts.agg(F.count_distinct("author_id").alias("t_authors"))).crossJoin(cross.agg((2 * F.count("*")).alias("t_cross")))


def shared_presence(active: DataFrame, posts: DataFrame) -> DataFrame:
    """u < v, o_active, o_repeat and o_authors: common users, their repeated presence, and common authors of posts.

    One join of activity with itself for all three; a pair of communities without a common user has no row.
    """
    wrote = posts.select(F.col("author_id").alias("user_id"), "community_id", F.lit(1).alias("w")).distinct()
    rows = active.join(wrote, ["user_id", "community_id"], "left").select("user_id", "community_id", F.col("activity_count")
        .alias("n"), F.coalesce("w", F.lit(0)).alias("w"))
    a = rows.select("user_id", F.col("community_id").alias("u"), F.col("n").alias("nu"), F.col("w").alias("wu"))
    b = rows.select("user_id", F.col("community_id").alias("v"), F.col("n").alias("nv"), F.col("w").alias("wv"))
    both = a.join(b, "user_id").where("u < v").groupBy("u", "v")
    return both.agg(F.count("*").alias("o_active"), F.least(F.sum(F.least("nu", "nv")), F.lit(100)).alias("o_repeat"), F.sum(F.col("wu") * F.col(
        "wv")).alias("o_authors"))


def pair_evidence(pairs: DataFrame, active: DataFrame, posts: DataFrame, cross: DataFrame, presence: DataFrame | None = None) -> DataFrame:
    """u, v and, for each layer, what was observed: common users, common authors, repeated presence, references."""
    o = shared_presence(active, posts) if presence is None else presence
    c = cross.groupBy(F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v")).agg(F.count("*").alias("o_cross"))
    found = pairs.join(o, ["u", "v"], "left").join(c, ["u", "v"], "left")
    return found.select("u", "v", *(F.coalesce(f"o_{k}", F.lit(0)).cast("long").alias(f"o_{k}") for k in LAYERS))


def raw_strength(observed: Column, left: Column, right: Column, universe: Column) -> Column:
    """Normalised pointwise mutual information, from 0 to 1, by the log of the evidence, shrunk where it is little."""
    p = observed / universe
    npmi = F.ln(p / ((left / universe) * (right / universe))) / -F.ln(p)
    clamped = F.when(observed >= universe, F.lit(1.0)).otherwise(F.greatest(F.least(npmi, F.lit(1.0)), F.lit(0.0)))
    return F.when(observed > 0, clamped * F.log1p(observed) * (observed / (observed + SHRINK))).otherwise(F.lit(0.0))


def valid(observed: Column, left: Column, right: Column, universe: Column) -> Column:
    """Evidence that can be: within both marginals, and those within the universe."""
    return (universe > 0) & (observed >= 0) & (observed <= left) & (observed <= right) & (left <= universe) & (right <= universe)


def scored(evidence: DataFrame) -> DataFrame:
    """Add raw_<layer> and affinity to evidence with o_, l_, r_ and t_ columns for each layer."""
    ok, raw = {}, {}
    for k in LAYERS:
        cols = [F.col(f"{p}_{k}").cast("double") for p in "olrt"]
        ok[k] = valid(*cols)
        raw[k] = F.when(ok[k], raw_strength(*cols)).otherwise(F.lit(0.0))
    weight = sum((F.when(ok[k], F.lit(w)).otherwise(F.lit(0.0)) for k, w in LAYERS.items()), F.lit(0.0))
    total = sum((F.when(ok[k], F.lit(w)).otherwise(F.lit(0.0)) * F.col(f"raw_{k}") for k, w in LAYERS.items()), F.lit(0.0))
    mean = F.when(weight > 0, total / weight).otherwise(F.lit(0.0))
    return evidence.withColumns({f"raw_{k}": raw[k] for k in LAYERS}).withColumn("affinity", mean / (1 + mean))


def affinity(active: DataFrame, posts: DataFrame, cross: DataFrame, least: int = 2) -> DataFrame:
    """u, v, the strength of each layer and affinity for all candidate pairs.

    What communities have in common is counted once, for the candidates and for their evidence.
    """
    active, posts, cross = staged(active, "affinity-activity"), staged(posts.select("author_id", "community_id"), "affinity-posts"), staged(
        cross.select("source", "target"), "affinity-cross")
    presence = staged(shared_presence(active, posts), "affinity-presence")
    near = presence.select(F.col("u").alias("source"), F.col("v").alias("target"), F.col("o_active").alias("overlap_count"))
    m = marginals(active, posts, cross)
    pairs = pair_evidence(candidates(near, cross, least), active, posts, cross, presence)
    left = m.select(F.col("id").alias("u"), *(F.col(f"m_{k}").alias(f"l_{k}") for k in LAYERS))
    right = m.select(F.col("id").alias("v"), *(F.col(f"m_{k}").alias(f"r_{k}") for k in LAYERS))
    full = pairs.join(left, "u", "left").join(right, "v", "left").na.fill(0).crossJoin(F.broadcast(totals(active, posts, cross)))  # totals: one row
    return scored(full).select("u", "v", *(F.col(f"raw_{k}") for k in LAYERS), "affinity")


def group_routes(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges (u, v, affinity) between groups (id, group_id): sum, mean up to one, and number for each pair of groups."""
    a = members.select(F.col("id").alias("u"), F.col("group_id").alias("gu"))
    b = members.select(F.col("id").alias("v"), F.col("group_id").alias("gv"))
    across = edges.join(a, "u").join(b, "v").where("gu <> gv")
    found = across.groupBy(F.least("gu", "gv").alias("source"), F.greatest("gu", "gv").alias("target")).agg(F.sum("affinity")
        .alias("total"), F.avg("affinity").alias("mean"), F.count("*").alias("edge_count"))
    return found.select("source", "target", "total", F.least("mean", F.lit(1.0)).alias("affinity"), "edge_count")


def macro_share(edges: DataFrame, members: DataFrame) -> DataFrame:
    """For each community its share of affinity in its own macro group and in the strongest other one, and whether it is a bridge."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("other"), "affinity"), F.struct(F.col("v")
        .alias("id"), F.col("u").alias("other"), "affinity"))).alias("e")).select("e.*")
    own = members.select("id", F.col("group_id").alias("own"))
    far = members.select(F.col("id").alias("other"), "group_id")
    by = ends.join(far, "other").groupBy("id", "group_id").agg(F.sum("affinity").alias("s")).join(own, "id")
    by = by.withColumn("total", F.sum("s").over(Window.partitionBy("id")))
    share = F.col("s") / F.col("total")
    agg = by.groupBy("id").agg(F.coalesce(F.sum(F.when(F.col("group_id") == F.col("own"), share)), F.lit(0.0))
        .alias("primary_share"), F.coalesce(F.max(F.when(F.col("group_id") != F.col("own"), share)), F.lit(0.0))
        .alias("secondary_share"))
    return agg.withColumn("is_bridge", is_bridge(F.col("primary_share"), F.col("secondary_share")))


def layers_of(scored_edges: DataFrame) -> DataFrame:
    """layer, u, v and raw of every positive component, with the weights of layers that have any made to sum to one."""
    stacked = scored_edges.select("u", "v", F.explode(F.array(*(F.struct(F.lit(k).alias("layer"), F.lit(w)
        .alias("w"), F.col(f"raw_{k}").alias("raw")) for k, w in LAYERS.items()))).alias("c")).select("u", "v", "c.*").where("raw > 0")
    present = stacked.select("layer", "w").distinct()
    total = present.agg(F.sum("w").alias("total"))
    return stacked.crossJoin(F.broadcast(total)).select("layer", "u", "v", "raw", (F.col("w") / F.col("total")).alias("weight"))  # total: one row
