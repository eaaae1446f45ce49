"""Modularity, label propagation, and Louvain with its hierarchy.

Label propagation and modularity are distributed. Louvain visits nodes one after another
by definition, so its kernel (louvain.py) runs in one task; larger graphs are merged by
label propagation until they fit one.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kithgraph.functions.columns import weight
from kithgraph.operators.layout import fnv1a
from kithgraph.operators.louvain import layer_of_arrays, multilevel, multilevel_of, nested
from kithgraph.operators.relational import links_among, top_nodes
from kithgraph.plans.staging import staged

#: Links of a graph, of all its layers together, that one task takes; larger ones are merged first.
KERNEL_LINKS = 2_000_000


def modularity(links: DataFrame, members: DataFrame) -> DataFrame:
    """One row: the modularity of communities (id, community_id) over undirected links (u, v, weight)."""
    both = links.select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b"), "weight"), F.struct(F.col("v")
        .alias("a"), F.col("u").alias("b"), "weight"))).alias("e")).select("e.*")
    total = both.agg(F.sum("weight").cast("double").alias("m2"))
    degree = both.groupBy(F.col("a").alias("id")).agg(F.sum("weight").alias("d")).join(members, "id")
    a = members.select(F.col("id").alias("a"), F.col("community_id").alias("ca"))
    b = members.select(F.col("id").alias("b"), F.col("community_id").alias("cb"))
    inner = both.join(a, "a").join(b, "b").where("ca = cb").agg(F.coalesce(F.sum("weight"), F.lit(0)).cast("double").alias("w"))
    by = degree.groupBy("community_id").agg(F.sum("d").cast("double").alias("k")).agg(F.coalesce(F.sum(F.col("k") * F.col("k")), F.lit(0.0))
        .alias("kk"))
    return total.crossJoin(inner).crossJoin(by).select((F.col("w") / F.col("m2") - F.col("kk") / (F.col("m2") * F.col("m2"))).alias("modularity"))  # one-row frames


def label_propagation(links: DataFrame, stage: Callable[[DataFrame], DataFrame] = staged, sweeps: int = 100) -> DataFrame:
    """id and label: in every sweep each node takes the heaviest label around it, the smaller one of ties, until none changes.

    Synchronous with a node's own label counted once, so results don't depend on any order.
    stage cuts the lineage after a sweep; links are undirected, loops don't count.
    """
    links = links.where("u <> v")
    both = stage(links.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("other"), "weight"), F.struct(F.col("v")
        .alias("id"), F.col("u").alias("other"), "weight"))).alias("e")).select("e.*"))
    now = both.select("id").distinct().withColumn("label", F.col("id"))
    for _ in range(sweeps):
        around = both.join(now.select(F.col("id").alias("other"), "label"), "other").select("id", "label", "weight")
        votes = around.unionByName(now.withColumn("weight", F.lit(1).cast(both.schema["weight"].dataType))).groupBy("id", "label").agg(F.sum(
            "weight").alias("w"))
        first = Window.partitionBy("id").orderBy(F.desc("w"), "label")
        best = votes.withColumn("_r", F.row_number().over(first)).where("_r = 1").select("id", "label")
        new = stage(best)
        moved = new.join(now.select("id", F.col("label").alias("was")), "id").where("label <> was").limit(1).count()
        now = new
        if not moved:
            break
    return now


def louvain(edges: list[tuple[str, str, float]], resolution: float = 1.0) -> list[dict[str, int]]:
    """Levels of Louvain on undirected weighted edges: node to community for each level, finest first."""
    return multilevel([edges], [1.0], resolution)[0]


def coarsened(links: DataFrame, most: int = KERNEL_LINKS) -> tuple[DataFrame, DataFrame | None]:
    """links (u, v, weight) between groups small enough for one task, and the members (id, group) where nodes were merged.

    Groups come from label propagation, which is distributed, once or several times;
    weights between them add up and weights inside become loops. Ends where it no longer helps.
    """
    members, before = None, math.inf
    while (n := links.count()) > most and n < 0.9 * before:
        before = n
        label = staged(label_propagation(links, sweeps=5), "coarse-labels")
        a, b = (label.select(F.col("id").alias(c), F.col("label").alias(f"g{c}")) for c in "uv")
        between = links.join(a, "u").join(b, "v").groupBy(F.least("gu", "gv").alias("u"), F.greatest("gu", "gv")
            .alias("v")).agg(F.sum("weight").alias("weight"))
        links = staged(between, "coarse-links")
        step = label.select("id", F.col("label").alias("group"))
        if members is not None:
            step = members.join(step.select(F.col("id").alias("_at"), F.col("group").alias("_to")), F.col("group") == F.col("_at")).select(
                "id", F.col("_to").alias("group"))
        members = staged(step, "coarse-members")
    return links, members


def hierarchy(links: DataFrame, resolutions: list[float], levels: int = 3, most: int = KERNEL_LINKS) -> DataFrame:
    """resolution, level (from 1), id and community_id, numbered by the smallest member; one task for each resolution.

    More than `most` links (u, v, weight) are merged first, see coarsened().
    """
    links, members = coarsened(links, most)

    def kernel(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found, _ = multilevel([zip(rows["u"], rows["v"], rows["weight"].astype(float), strict=True)], [1.0], float(key[0]))
        out = [pd.DataFrame({"resolution": float(key[0]), "level": k + 1, "id": list(f), "community_id": list(f.values())}) for k, f in enumerate(
            found[:levels])]
        return pd.concat(out)

    kind = links.schema["u"].dataType.simpleString()
    each = links.select("u", "v", "weight", F.explode(F.array(*map(F.lit, map(float, resolutions)))).alias("resolution"))
    found = each.groupBy("resolution").applyInPandas(kernel, f"resolution double, level int, id {kind}, community_id long")
    if members is None:
        return found
    return found.withColumnRenamed("id", "group").join(members, "group").select("resolution", "level", "id", "community_id")


def multiplex_partitions(layers: DataFrame, resolutions: list[float]) -> DataFrame:
    """resolution, id, community_id and modularity of Louvain over layers (layer, u, v, raw, weight), one task for each resolution.

    raw are the links' strengths, weight is the layer's; links without strength and loops don't
    count. A graph over KERNEL_LINKS is merged first, by all layers together.
    """
    rows = layers.where("raw > 0 and u <> v").select("layer", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "raw", "weight")
    # Strengths are far below the one that a node's own label counts, so scaled ones decide who merges.
    _, members = coarsened(multiplex(rows).withColumn("weight", F.col("weight") * 1e6), KERNEL_LINKS // max(1, rows.select("layer").distinct().count()))
    if members is not None:
        a, b = (members.select(F.col("id").alias(c), F.col("group").alias(f"g{c}")) for c in "uv")
        merged = rows.join(a, "u").join(b, "v").groupBy("layer", F.least("gu", "gv").alias("u"), F.greatest("gu", "gv").alias("v"))
        rows = merged.agg(F.sum("raw").alias("raw"), F.max("weight").alias("weight"))

    # A pair comes once in a layer, and layers are numbers, so a task holds links as arrays until the kernel's own tables are made.
    summed = rows.groupBy("layer", "u", "v").agg(F.sum(F.col("raw").cast("double")).alias("raw"))
    known = sorted((r["layer"], float(r["weight"])) for r in rows.groupBy("layer").agg(F.max("weight").alias("weight")).collect())  # one row a layer
    number = F.create_map(*(F.lit(x) for k, (name, _) in enumerate(known) for x in (name, k))) if known else F.create_map(F.lit(""), F.lit(0))
    rows = summed.select(number[F.col("layer")].alias("layer"), "u", "v", "raw")

    def kernel(key: tuple, table: pa.Table) -> pa.Table:
        ends = pa.chunked_array([*table["u"].chunks, *table["v"].chunks]).dictionary_encode().combine_chunks()
        found = ends.dictionary.to_pylist()
        names = sorted(found)
        rank = {x: k for k, x in enumerate(names)}
        at = np.array([rank[x] for x in found], np.int32)[ends.indices.to_numpy()]
        u, v = at[: len(table)], at[len(table) :]
        low, high = np.minimum(u, v), np.maximum(u, v)
        layer, raw = table["layer"].to_numpy(), table["raw"].to_numpy()
        order = np.lexsort([high, low, layer])
        cut = np.searchsorted(layer[order], np.arange(len(known) + 1))
        parts = [order[lo:hi] for lo, hi in zip(cut[:-1], cut[1:], strict=True)]
        layers = [layer_of_arrays(low[p], high[p], raw[p], len(names)) for p in parts]
        levels, q = multilevel_of(names, layers, [w for _, w in known], key[0].as_py())
        last = levels[-1]
        return pa.table({"resolution": pa.array([key[0].as_py()] * len(last), pa.float64()), "id": pa.array(list(last), table["u"].type),
            "community_id": pa.array(list(last.values()), pa.int64()), "modularity": pa.array([q] * len(last), pa.float64())})

    kind = rows.schema["u"].dataType.simpleString()
    each = rows.withColumn("resolution", F.explode(F.array(*map(F.lit, map(float, resolutions)))))
    found = each.groupBy("resolution").applyInArrow(kernel, f"resolution double, id {kind}, community_id long, modularity double")
    if members is None:
        return found
    return found.withColumnRenamed("id", "group").join(members, "group").select("resolution", "id", "community_id", "modularity")


def nested_communities(nodes: DataFrame, links: DataFrame, most_nodes: int = 10_000, most_links: int = 50_000) -> DataFrame:
    """level, id, community_id, finer_id, coarser_id and modularity of nested communities of the heaviest nodes.

    finer_id is the community of the level before that a community consists of alone, else
    null; coarser_id the one of the next level that holds it. The graph is capped, so it fits one task.
    """
    kept = top_nodes(nodes, most_nodes).select("id", weight().alias("w"))
    among = links_among(links, kept, most_links)
    rows = kept.select(F.col("id").alias("source"), F.lit(None).cast("string").alias("target"), "w")
    both = rows.unionByName(among, allowMissingColumns=True).withColumn("one", F.lit(1))

    def kernel(frame: pd.DataFrame) -> pd.DataFrame:
        own = frame[frame["target"].isna()].sort_values(["w", "source"], ascending=[False, True])
        e = frame.dropna(subset=["target"])
        found = nested(own["source"].tolist(), list(zip(e["source"], e["target"], strict=True)))
        out = []
        for at, after in zip(found, [*found[1:], None], strict=True):
            ids = list(at.community)
            coarser = [after.community[x] if after else None for x in ids]
            finer = [at.finer.get(c) for c in at.community.values()]
            out.append(pd.DataFrame({"level": at.level, "id": ids, "community_id": list(at.community.values()), "finer_id": finer,
                "coarser_id": coarser, "modularity": at.modularity}).astype({"finer_id": "Int64", "coarser_id": "Int64"}))
        return pd.concat(out)

    return both.groupBy("one").applyInPandas(kernel, "level int, id string, community_id long, finer_id long, coarser_id long, modularity double")


def flat_communities(nodes: DataFrame, links: DataFrame, most_nodes: int = 10_000, most_links: int = 50_000) -> DataFrame:
    """id and community_id of one pass over the heaviest nodes with unit weights, see louvain.flat()."""
    found = nested_communities(nodes, links, most_nodes, most_links)
    return found.where("level = 1").select("id", "community_id")


def from_hierarchy(found: DataFrame) -> DataFrame:
    """community_id, label, size and modularity of the communities of level 1 of nested ones."""
    by = found.where("level = 1").groupBy("community_id").agg(F.count("*").alias("size"), F.max("modularity").alias("modularity"))
    return by.select("community_id", F.concat(F.lit("Community "), (F.col("community_id") + 1).cast("string")).alias("label"), "size", "modularity")


def stored_hierarchy(found: DataFrame, positions: DataFrame) -> DataFrame:
    """id, level, community_id, finer_id and the community's centroid: nested communities as rows to store."""
    placed = found.join(positions.select("id", "pos_x", "pos_y", "pos_z"), "id", "left")
    centre = placed.groupBy("level", "community_id").agg(*(F.avg(f"pos_{a}").alias(f"centroid_{a}") for a in "xyz"))
    return found.select("id", "level", "community_id", "finer_id").join(centre, ["level", "community_id"])


def fine_selection(found: DataFrame, nodes: int | None = None) -> DataFrame:
    """id and community_id of the partition (resolution, id, community_id, modularity) that passes the gate with most modularity.

    Empty where none passes. nodes is how many have any evidence; those of the partitions if not given.
    """
    named = found.withColumn("level", F.lit(1))
    held = found.agg(F.count_distinct("id").alias("n")).first()["n"] if nodes is None else nodes
    gate = partition_gate(named, max(held, 1)).where("accepted").select("resolution")
    best = found.join(gate, "resolution").groupBy("resolution").agg(F.max("modularity").alias("q")).orderBy(F.desc("q"), "resolution").limit(
        1).select("resolution")
    return found.join(F.broadcast(best), "resolution").select("resolution", "id", "community_id", "modularity")  # best: one row


def community_graph(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """u, v and weight between communities: the affinity of pairs (u, v, affinity) across them, summed."""
    a, b = (members.select(F.col("id").alias(c), F.col("community_id").alias(f"c{c}")) for c in "uv")
    across = pairs.join(a, "u").join(b, "v").where("cu <> cv")
    return across.groupBy(F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v")).agg(F.sum("affinity").alias("weight"))


#: Resolutions that are tried. Fixed values.
FINE, MACRO = (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0), (0.05, 0.1, 0.2, 0.35, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0)


def partition_gate(found: DataFrame, members: int, least_held: float = 0.95, most_single: float = 0.2, sizes: tuple[float, float] = (5, 500)) -> DataFrame:
    """For each resolution of level 1: the part of nodes outside singletons, the part of singleton communities, the median size, and whether all are in range."""
    size = found.where("level = 1").groupBy("resolution", "community_id").agg(F.count("*").alias("n"))
    by = size.groupBy("resolution").agg(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("held"), F.avg((F.col("n") == 1)
        .cast("double")).alias("single"), F.expr("percentile(n, 0.5)").alias("median"), F.count("*").alias("communities"))
    ok = (F.col("held") / members >= least_held) & (F.col("single") < most_single) & F.col("median").between(*sizes)
    return by.select("resolution", "communities", (F.col("held") / members).alias("held"), "single", "median", ok.alias("accepted"))


def multiplex(layers: DataFrame) -> DataFrame:
    """One weighted graph (u, v, weight) of layers (layer, u, v, raw, weight): weights times strengths, summed over layers."""
    return layers.groupBy("u", "v").agg(F.sum(F.col("raw") * F.col("weight")).alias("weight"))


def macro_selection(found: DataFrame, links: DataFrame, groups: tuple[int, int] = (8, 12)) -> DataFrame:
    """resolution, communities and modularity of level-1 partitions, best first, those with the wanted number of groups ahead."""
    level = found.where("level = 1").select("resolution", "id", "community_id")
    both = links.select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b"), "weight"), F.struct(F.col("v")
        .alias("a"), F.col("u").alias("b"), "weight"))).alias("e")).select("e.*")
    m2 = both.agg(F.sum("weight").cast("double").alias("m2"))
    degree = both.groupBy(F.col("a").alias("id")).agg(F.sum("weight").cast("double").alias("d")).join(level, "id")
    kk = degree.groupBy("resolution", "community_id").agg(F.sum("d").alias("k")).groupBy("resolution").agg(F.sum(F.col("k") * F.col("k"))
        .alias("kk"), F.count("*").alias("communities"))
    a = level.select("resolution", F.col("id").alias("a"), F.col("community_id").alias("ca"))
    b = level.select("resolution", F.col("id").alias("b"), F.col("community_id").alias("cb"))
    w = both.join(a, "a").join(b, ["resolution", "b"]).where("ca = cb").groupBy("resolution").agg(F.sum("weight").cast("double").alias("w"))
    q = F.coalesce("w", F.lit(0.0)) / F.col("m2") - F.col("kk") / (F.col("m2") * F.col("m2"))
    out = kk.join(w, "resolution", "left").crossJoin(F.broadcast(m2)).select("resolution", "communities", q.alias("modularity"))  # m2: one row
    fits = F.col("communities").between(*groups)
    return out.withColumn("accepted", fits).orderBy(F.desc("accepted"), F.desc("modularity"), "resolution")


#: Colours of the palette's roles, in the order in which new groups take them. Fixed values.
PALETTE = ("#68DCFF", "#B6FF62", "#FF7096", "#FFC75F", "#B39DFF", "#5EE0B8", "#FF936B", "#8FB8FF", "#E4E86A", "#E18BEA", "#70D48B", "#D9A96E")


def palette_roles(groups: list[str], kept: dict[str, str]) -> dict[str, str]:
    """A role for each of at most twelve macro groups: the one it had, else the first that is free."""
    out = {g: kept[g] for g in groups if g in kept}
    free = [r for r in PALETTE if r not in out.values()]
    for g in sorted(set(groups) - set(out)):
        out[g] = free.pop(0) if free else PALETTE[fnv1a(g) % len(PALETTE)]
    return out

