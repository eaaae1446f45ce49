"""Boxes, centroids, bundles and bounds of positioned nodes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithgraph.functions.columns import by_weight

AXES = ("pos_x", "pos_y", "pos_z")


def box(nodes: DataFrame, bounds: tuple[float, float, float, float, float, float], flat: bool = False) -> DataFrame:
    """Positioned nodes inside a box (x0, x1, y0, y1, z0, z1); flat ignores z but asks for one."""
    if not all(map(math.isfinite, bounds)) or any(a > b for a, b in zip(bounds[::2], bounds[1::2], strict=True)):
        raise ValueError("a box needs finite bounds in order")
    held = nodes.where(F.col("pos_z").isNotNull())
    for k, c in enumerate(AXES[:2] if flat else AXES):
        held = held.where(F.col(c).between(bounds[2 * k], bounds[2 * k + 1]))
    return held


def box_page(nodes: DataFrame, bounds: tuple[float, float, float, float, float, float], most: int, flat: bool = False) -> DataFrame:
    return box(nodes, bounds, flat).orderBy(*by_weight()).limit(most)


#: Types shown at a level of detail.
DETAIL = {"far": ("community",), "medium": ("community", "user"), "near": ("community", "user"), "inspect": ("community", "user", "post")}


def region(nodes: DataFrame, suppressed: DataFrame, bounds: tuple[float, float, float, float, float, float], detail: str, most: int, start: int = 0) -> DataFrame:
    """A box at a level of detail, without suppressed entities."""
    shown = box(nodes, bounds).where(F.col("type").isin(*DETAIL[detail]))
    return visible(shown, suppressed).orderBy(*by_weight()).offset(start).limit(most)


def visible(entities: DataFrame, suppressed: DataFrame) -> DataFrame:
    """Without entities that are suppressed and not restored."""
    return entities.join(suppressed.where("restored_at is null").select(F.col("entity_id").alias("id")), "id", "left_anti")


def centroids(members: DataFrame) -> DataFrame:
    """Mean position and number of each community's positioned members."""
    return members.where(F.col("pos_x").isNotNull()).groupBy("community_id").agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in AXES))


def supernodes(communities: DataFrame, members: DataFrame) -> DataFrame:
    """Communities with their size and mean position, zero without positioned members."""
    found = members.groupBy("community_id").agg(F.count("*").alias("size"), *(F.avg(c).alias(c) for c in AXES))
    return communities.join(found, "community_id", "left").select("community_id", F.coalesce("size", F.lit(0))
        .alias("size"), *(F.coalesce(c, F.lit(0.0)).alias(c) for c in AXES))


def bounds(nodes: DataFrame) -> DataFrame:
    """One row: number and range on each axis, zero without nodes."""
    return nodes.agg(F.count("*").alias("n"), *(F.coalesce(f(c), F.lit(0.0)).alias(f"{n}_{c[-1]}") for c in AXES for n, f in (("min", F.min),
        ("max", F.max))))


def bundle_weights(links: DataFrame, members: DataFrame) -> DataFrame:
    """source, target and weight of links between different communities, of links and members (id, community_id)."""
    a = members.select(F.col("id").alias("source"), F.col("community_id").alias("cu"))
    b = members.select(F.col("id").alias("target"), F.col("community_id").alias("cv"))
    across = links.join(a, "source").join(b, "target").where("cu <> cv")
    return across.groupBy(F.least("cu", "cv").alias("source"), F.greatest("cu", "cv").alias("target")).agg(F.count("*").alias("weight"))


def bundles(weights: DataFrame, centres: DataFrame, offset: float = 0.2) -> DataFrame:
    """Control points: the midpoint, moved to the side in the xy plane by a part of the length."""
    a = centres.select(F.col("community_id").alias("source"), *(F.col(c).alias(f"a_{c[-1]}") for c in AXES))
    b = centres.select(F.col("community_id").alias("target"), *(F.col(c).alias(f"b_{c[-1]}") for c in AXES))
    j = weights.join(a, "source").join(b, "target")
    mid = {k: (F.col(f"a_{k}") + F.col(f"b_{k}")) / 2 for k in "xyz"}
    return j.select("source", "target", "weight", (mid["x"] - offset * (F.col("b_y") - F.col("a_y")))
        .alias("control_x"), (mid["y"] + offset * (F.col("b_x") - F.col("a_x"))).alias("control_y"), mid["z"].alias("control_z"))


def radius_quantile(nodes: DataFrame, part: float = 0.95) -> DataFrame:
    """The nearest-rank quantile of the distance from the origin."""
    r = F.sqrt(sum((F.col(c) * F.col(c) for c in AXES), F.lit(0.0)))
    return nodes.select(r.alias("r")).agg(F.expr(f"percentile_disc({part}) within group (order by r)").alias("radius"))


def cosine_weights(edges: DataFrame) -> DataFrame:
    """u, v and weight over the root of both ends' strengths."""
    s = edges.select(F.explode(F.array("u", "v")).alias("id"), "weight").groupBy("id").agg(F.sum("weight").alias("strength"))
    j = edges.join(s.select(F.col("id").alias("u"), F.col("strength").alias("su")), "u").join(s.select(F.col("id")
        .alias("v"), F.col("strength").alias("sv")), "v")
    return j.select("u", "v", (F.col("weight") / F.sqrt(F.col("su") * F.col("sv"))).alias("weight"))


def directional_nearest(nodes: DataFrame, at: tuple[str, float, float], axis: str, sign: int) -> DataFrame:
    """The next node along an axis: the least distance plus 0.7 of what lies across."""
    key, x, y = at
    dx, dy = F.col("pos_x") - x, F.col("pos_y") - y
    along, across = (dx, dy) if axis == "x" else (dy, dx)
    cost = F.sqrt(dx * dx + dy * dy) + 0.7 * F.abs(across)
    return nodes.where((F.col("id") != key) & (along * sign > 0)).select("id", cost.alias("cost")).orderBy("cost", "id").limit(1)


def in_sphere(nodes: DataFrame, centre: tuple[float, float, float], radius: float) -> DataFrame:
    d2 = sum(((F.col(c) - v) * (F.col(c) - v) for c, v in zip(AXES, centre, strict=True)), F.lit(0.0))
    return nodes.where(d2 <= radius * radius)


def in_frustum(nodes: DataFrame, planes: list[tuple[float, float, float, float]]) -> DataFrame:
    """Nodes on the inner side of every plane (a, b, c, d): ax + by + cz + d >= 0."""
    keep: Column = F.lit(True)
    for a, b, c, d in planes:
        keep = keep & (a * F.col("pos_x") + b * F.col("pos_y") + c * F.col("pos_z") + d >= 0)
    return nodes.where(keep)


def near_ray(nodes: DataFrame, origin: tuple[float, float, float], direction: tuple[float, float, float], most: float) -> DataFrame:
    """id and the distance along a ray of the nodes at most so far from it, nearest first."""
    n = math.sqrt(sum(d * d for d in direction))
    unit = [d / n for d in direction]
    rel = [F.col(c) - o for c, o in zip(AXES, origin, strict=True)]
    along = sum((r * u for r, u in zip(rel, unit, strict=True)), F.lit(0.0))
    d2 = sum((r * r for r in rel), F.lit(0.0)) - along * along
    return nodes.where((along >= 0) & (d2 <= most * most)).select("id", along.alias("along"))


def detail_tier(distance: Column, near: float = 500, medium: float = 1000, far: float = 2000) -> Column:
    """Level of detail by the distance to the camera."""
    return F.when(distance < near, "high").when(distance < medium, "medium").when(distance < far, "low").otherwise("hidden")


def link_opacity(distance: Column, base: float = 0.6, seen: float = 1200, least: float = 0.1, most: float = 0.8) -> Column:
    """A link's opacity by the distance to the camera: as it is within half of `seen`, then fading, within a range."""
    part = F.greatest(F.lit(0.0), 1 - (distance - seen / 2) / seen)
    return F.when(distance < seen / 2, F.lit(min(most, base))).otherwise(F.greatest(F.lit(least), F.least(F.lit(most), base * part)))


def region_links(shown: DataFrame, links: DataFrame, entities: DataFrame, most: int) -> DataFrame:
    """source, target, relation, directed and weight of links between what a region shows (id), the heaviest first.

    Stored links (with relation, directed and weight) and those that entities (id, type,
    parent_id, author_id) name themselves.
    """
    keys = shown.select("id")
    ends = [keys.withColumnRenamed("id", e) for e in ("source", "target")]
    held = links.join(ends[0], "source", "left_semi").join(ends[1], "target", "left_semi").select("source", "target", "relation", "directed",
        "weight")
    own = entities.join(keys, "id", "left_semi")
    made = structural(own).join(ends[0], "source", "left_semi").join(ends[1], "target", "left_semi")
    both = held.unionByName(made.select("source", "target", "relation", F.lit(True).alias("directed"), F.lit(1).cast("long").alias("weight")))
    return both.orderBy(F.desc("weight"), "source", "target", "relation").limit(most)


def structural(rows: DataFrame) -> DataFrame:
    """source, target and relation of the links that entities name as author and parent."""
    made = F.array(
        F.struct(F.col("author_id").alias("source"), F.col("id").alias("target"), F.when(F.col("author_id")
            .isNotNull(), F.lit("authorship")).alias("relation")),
        F.struct(
            F.col("id").alias("source"),
            F.col("parent_id").alias("target"),
            F.when(F.col("type") == "post", "published_in").when(F.col("parent_id").startswith("comment_"), "reply").when(F.col("parent_id")
                .startswith("post_"), "comment_on").alias("relation"),
        ),
    )
    return rows.select(F.explode(made).alias("l")).select("l.*").where("source is not null and target is not null and relation is not null")
