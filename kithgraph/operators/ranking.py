"""Top-k, ranks within groups, pages and retention. Every order ends in a unique key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kithgraph.functions.columns import by_weight, weight


def first_by(df: DataFrame, keys: list[str], order: list[Column], most: int = 1) -> DataFrame:
    """The first rows of each group. Spark's window group limit drops the rest before the shuffle."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rank") <= most).drop("_rank")


def mutual_best(shared: DataFrame) -> DataFrame:
    """Of (new_id, old_id, weight): pairs that are each other's best, by weight and then id."""
    forward = Window.partitionBy("new_id").orderBy(F.desc("weight"), "old_id")
    back = Window.partitionBy("old_id").orderBy(F.desc("weight"), "new_id")
    ranked = shared.withColumns({"_f": F.row_number().over(forward), "_b": F.row_number().over(back)})
    return ranked.where("_f = 1 and _b = 1").select("new_id", "old_id", "weight")


def top_names(rows: DataFrame, group: str, most: int = 3) -> DataFrame:
    """The names of each group's heaviest rows, joined by a dot."""
    kept = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("value"), "name"))).where(F.col("_rank") <= most)
    named = F.array_sort(F.collect_list(F.struct("_rank", "name")))
    return kept.groupBy(group).agg(F.array_join(F.transform(named, lambda x: x["name"]), " · ").alias("label"))


def typed_quota(nodes: DataFrame, quotas: dict[str, int | None], cap: int | None) -> DataFrame:
    """The heaviest nodes of each type up to its quota, types in their order, then capped.

    Without any quota the heaviest nodes of all types. A quota of None takes all of its type;
    a cap of None takes all that the quotas leave, in no order.
    """
    if not any(q is None or q for q in quotas.values()):
        return nodes if cap is None else nodes.orderBy(*by_weight()).limit(cap)
    whole = nodes.where(F.col("type").isin(*[t for t, q in quotas.items() if q is None]))
    if not any(quotas.values()):
        ranked = whole
    else:
        ranked = _within_quotas(nodes, {t: q for t, q in quotas.items() if q is not None}).unionByName(whole)
    if cap is None:
        return ranked
    place = F.create_map(*(x for k, t in enumerate(quotas) for x in (F.lit(t), F.lit(k))))
    return ranked.orderBy(place[F.col("type")], *by_weight()).limit(cap)


def _within_quotas(nodes: DataFrame, quotas: dict[str, int]) -> DataFrame:
    kept = first_by(nodes.where(F.col("type").isin(*[t for t, q in quotas.items() if q])), ["type"], by_weight(), max(quotas.values()))
    limit = F.create_map(*(x for t, q in quotas.items() for x in (F.lit(t), F.lit(q))))
    ranked = kept.withColumn("_rank", F.row_number().over(Window.partitionBy("type").orderBy(*by_weight())))
    return ranked.where(F.col("_rank") <= limit[F.col("type")]).drop("_rank")


def overview_rank(landmarks: DataFrame, reserved: int = 5) -> DataFrame:
    """Overall rank of landmarks (id, macro_id, score): a few of each macro group first, in turn, then by score."""
    inner = landmarks.withColumn("macro_rank", F.row_number().over(Window.partitionBy("macro_id").orderBy(F.desc("score"), "id")))
    first = F.col("macro_rank") <= reserved
    order = Window.orderBy(F.when(first, 0).otherwise(1), F.when(first, F.col("macro_rank")).otherwise(0), F.desc("score"), "id")
    return inner.withColumn("overview_rank", F.row_number().over(order))


def strongest_edges(edges: DataFrame, most: int, cap: int) -> DataFrame:
    """Edges (u, v, weight) among the strongest of either end."""
    ends = edges.select("u", "v", "weight", F.explode(F.array(F.struct(F.col("u").alias("at"), F.col("v")
        .alias("other")), F.struct(F.col("v").alias("at"), F.col("u").alias("other")))).alias("e"))
    w = Window.partitionBy("e.at").orderBy(F.desc("weight"), "e.other")
    kept = ends.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= most).select("u", "v", "weight").distinct()
    return kept.orderBy(F.desc("weight"), "u", "v").limit(cap)


def page_links(page: DataFrame, links: DataFrame, size: int) -> DataFrame:
    """Links inside a page of nodes (id): at most five for each node that was asked for."""
    from kithgraph.operators.relational import links_among

    return links_among(links, page, 5 * size)


def keyset_page(nodes: DataFrame, size: int, after: tuple[int, str] | None = None) -> DataFrame:
    """The page after (weight, id); one row more than size tells whether there is another."""
    if after is not None:
        w, key = after
        nodes = nodes.where((weight() < w) | ((weight() == w) & (F.col("id") > key)))
    return nodes.orderBy(*by_weight()).limit(size + 1)


def offset_page(rows: DataFrame, order: list[Column | str], size: int, start: int) -> DataFrame:
    return rows.orderBy(*order).offset(start).limit(size)


def beyond(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """Rows after the first `most`: an anti-join with a bounded top-k, so nothing is ranked in one task."""
    return rows.join(rows.orderBy(*order).limit(most).select("id"), "id", "left_anti")


def expired(versions: DataFrame, keep: int, current: int, referred: DataFrame | None = None) -> DataFrame:
    """Versions that retention drops: all but the newest, the current one and those referred to (id)."""
    newest = versions.orderBy(F.desc("id")).limit(keep).select("id")
    found = versions.join(newest, "id", "left_anti").where(F.col("id") != current)
    return found if referred is None else found.join(referred.select("id"), "id", "left_anti")


def due(jobs: DataFrame, now: str) -> DataFrame:
    """Enabled jobs whose time has come, by priority."""
    return jobs.where(F.col("enabled") & (F.col("next_run") <= F.lit(now).cast("timestamp"))).orderBy(F.desc("priority"), "next_run", "id")
