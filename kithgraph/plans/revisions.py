"""Whole builds: the spatial catalog, immutable revisions on top of it, and the promotion of an affinity build.

A build is a dictionary of tables, written and gated by publish.Store. Every step is a
plan over the tables before it; what several steps read again is staged once.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kithgraph.functions.columns import confidence, distinctiveness, is_bridge, shade, typed_id
from kithgraph.operators import affinity, communities, integrity, layout, ranking, relational, scopes, search, spatial
from kithgraph.plans import catalog, publish
from kithgraph.plans.staging import staged
from kithgraph.sources.corpus import Corpus

AXES = ("pos_x", "pos_y", "pos_z")
#: The rule by which entities are placed; another one places everything anew.
PLACEMENT = "linked-world-1"
#: Caps of a revision by type of node, of all nodes, and of links. Fixed values.
CAPS = {"community": 70_000, "user": 30_000, "post": 0, "comment": 0}
NODES, LINKS = 100_000, 200_000
#: Caps of a revision that takes all nodes of all types.
EVERY = dict.fromkeys(CAPS)
#: Macro groups of a promoted build, communities in each at least, and the part of fallback labels among the first landmarks.
MACRO_GROUPS, LEAST_COMMUNITIES, MOST_FALLBACK, LANDMARKS = (8, 12), 5, 0.05, 300


def placed_anew(previous: str | None, placement: str = PLACEMENT) -> bool:
    """Whether a catalog must be laid out from nothing: there was none, or another rule placed it."""
    return previous is None or previous != placement


@dataclass
class Catalog:
    """entities (id, label, type, value, parent_id, author_id, community_id, position, provenance), documents, links, metrics and reports."""

    entities: DataFrame
    documents: DataFrame
    links: DataFrame
    metrics: DataFrame
    report: DataFrame
    quantiles: DataFrame
    checksum: DataFrame
    watermark: str
    placement: str = PLACEMENT

    def tables(self) -> dict[str, DataFrame]:
        return {"entities": self.entities, "documents": self.documents, "links": self.links, "metrics": self.metrics, "report": self.report,
            "quantiles": self.quantiles, "checksum": self.checksum}


def hashed_seed(key: Column, reach: float) -> list[Column]:
    """A position by a hash of the key within a box."""
    return [((F.pmod(F.xxhash64(key, F.lit(a)), F.lit(20_000)) - 10_000) / 10_000.0 * reach).alias(f"pos_{a}") for a in "xyz"]


def community_edges(c: Corpus) -> DataFrame:
    """u, v and weight of communities that share users."""
    edges = spatial.cosine_weights(relational.overlap_projection(c.kept_relationships))
    return staged(edges.select(typed_id("community", "u").alias("u"), typed_id("community", "v").alias("v"), "weight"), "catalog-edges")


def community_places(c: Corpus, edges: DataFrame, rounds: int, previous: DataFrame | None = None) -> DataFrame:
    """id and position of communities: those that share users by a force layout (what was placed stays), others on a shell around it."""
    linked = edges.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    bodies = linked
    if previous is not None:
        bodies = linked.join(previous.select("id", *AXES), "id", "left").withColumn("pinned", F.col("pos_x").isNotNull())
    laid = staged(layout.layout(bodies, edges, "world", rounds), "catalog-layout")
    alone = c.communities.select(typed_id("community", "id").alias("id")).join(linked, "id", "left_anti")
    return laid.unionByName(layout.shell_positions(alone, 60_000.0))


def build_catalog(c: Corpus, watermark: str, rounds: int = layout.ROUNDS["world"], previous: Catalog | None = None) -> Catalog:
    """All entities up to a watermark with metrics, positions, documents and links, and what its gates found.

    A warm build keeps what the previous catalog placed under the same rule.
    """
    warm = previous is not None and not placed_anew(previous.placement)
    # A layout is one task for long. Its edges come first, with all cores; what doesn't need it is written beside it.
    edges = community_edges(c)
    with ThreadPoolExecutor(1) as pool:
        laying = pool.submit(lambda: staged(community_places(c, edges, rounds, previous.entities if warm else None), "catalog-places"))
        posts = staged(relational.at_watermark(c.posts, watermark), "catalog-posts")
        comments = staged(relational.at_watermark(c.comments, watermark), "catalog-comments")
        active = staged(relational.activity(posts, comments), "catalog-activity")
        rows = staged(catalog.entities(c.communities, c.users, posts, comments, active), "catalog-entities")
        laid = laying.result()
    before = previous.entities.select("id", *AXES) if warm else rows.limit(0).select("id", *(F.lit(None).cast("double").alias(a) for a in AXES))
    anchored = rows.select("id", F.when(F.col("type") != "community", F.col("community_id")).alias("anchor_id"))
    places = catalog.warm_start(anchored, before, laid, placed=laid, near=400.0)
    whole = staged(rows.join(places, "id"), "catalog-placed")
    documents = posts.select(typed_id("post", "id").alias("id"), "title", F.lit(None).cast("string").alias("body")).unionByName(
        comments.select(typed_id("comment", "id").alias("id"), F.lit(None).cast("string").alias("title"), "body")
    )
    overlap = relational.overlap_projection(c.kept_relationships)
    links = catalog.structural_links(rows).select("source", "target", "relation", F.lit(True).alias("directed"), F.lit(1)
        .cast("long").alias("weight"))
    links = links.unionByName(
        overlap.select(typed_id("community", "u").alias("source"), typed_id("community", "v").alias("target"), F.lit("overlap")
            .alias("relation"), F.lit(False).alias("directed"), F.col("weight").cast("long").alias("weight"))
    )
    known = staged(catalog.automated(c.users, active, catalog.KNOWN_BOTS, c.overrides), "catalog-automated")
    metrics = catalog.metrics(c.communities, c.users, posts, comments, known)
    report = staged(catalog.validation(whole, positions=whole, documents=documents), "catalog-report")
    return Catalog(whole, documents, links, metrics, report, catalog.quantiles(rows), catalog.checksum(rows, "catalog", watermark), watermark)


def selected_nodes(entities: DataFrame, caps: dict[str, int | None], most: int | None) -> DataFrame:
    """The entities of a revision: the heaviest of each type, types in their order, capped; all where a cap is None."""
    named = entities.select("id", F.col("label").alias("name"), F.col("value").cast("string").alias("val"), "type", *AXES, "provenance")
    return ranking.typed_quota(named, caps, most)


def projected_links(
    nodes: DataFrame, active: DataFrame, relationships: DataFrame, structural: DataFrame, caps: dict[str, int | None], most: int | None
) -> DataFrame:
    """source, target, relation, directed and weight between a revision's nodes, the heaviest first.

    Activity and overlap are capped before they meet the rest; what posts and comments link
    counts only where the revision has any. Where most is None all links, in no order.
    """
    ends = [nodes.select(F.col("id").alias(e)) for e in ("source", "target")]

    def among(rows: DataFrame) -> DataFrame:
        return rows.join(ends[0], "source", "left_semi").join(ends[1], "target", "left_semi").where("source <> target")

    def heaviest(rows: DataFrame, *order: Column | str) -> DataFrame:
        return rows if most is None else rows.orderBy(*order).limit(most)

    order = [F.desc("weight"), "source", "target"]
    a = active.select(
        typed_id("user", "user_id").alias("source"), typed_id("community", "community_id").alias("target"), F.lit("user_activity").alias(
            "relation"), F.lit(True).alias("directed"), F.col("activity_count").cast("long").alias("weight")
    )
    for end in ("source", "target"):  # before both directions meet, so only the nodes' own do
        relationships = relationships.join(nodes.select(F.col("id").alias("_id")), typed_id("community", end) == F.col("_id"), "left_semi")
    o = relational.reciprocal(relationships).select(
        typed_id("community", "u").alias("source"), typed_id("community", "v").alias("target"), F.lit("overlap").alias("relation"), F.lit(
            False).alias("directed"), F.col("weight").cast("long").alias("weight")
    )
    parts = [heaviest(among(x).select("source", "target", "relation", "directed", "weight"), *order) for x in (a, o)]
    kinds = [r for t, rs in (("post", ["authorship", "published_in"]), ("comment", ["authorship", "reply", "comment_on"])) if caps.get(t, 0) != 0 for r in rs]
    if kinds:
        s = structural.where(F.col("relation").isin(*set(kinds)))
        parts.append(among(s).select("source", "target", "relation", F.lit(True).alias("directed"), F.lit(1).cast("long").alias("weight")))
    return heaviest(reduce(DataFrame.unionByName, parts), *order, "relation")


def landmarks(members: DataFrame, entities: DataFrame, previous: DataFrame | None, moved: bool) -> DataFrame:
    """community_id, label, size and position of communities (members: id, community_id).

    Named by the three heaviest communities among the members. Where the previous revision
    had it, unless everything has moved; else at its members' centre, else by a hash.
    """
    named = members.join(entities.select("id", "label", "value", "type", *AXES), "id")
    tops = ranking.top_names(named.where("type = 'community'").select("community_id", F.col("label").alias("name"), "value"), "community_id")
    size = members.groupBy("community_id").agg(F.count("*").alias("size"))
    centre = named.groupBy("community_id").agg(*(F.avg(a).alias(f"_c{a}") for a in AXES))
    j = size.join(tops, "community_id", "left").join(centre, "community_id", "left")
    if previous is None:
        j = j.withColumns({f"_p{a}": F.lit(None).cast("double") for a in AXES})
    else:
        j = j.join(previous.select("community_id", *(F.col(a).alias(f"_p{a}") for a in AXES)), "community_id", "left")
    seeds = hashed_seed(F.col("community_id"), 1000.0)
    kept = [F.coalesce(*([F.col(f"_c{a}")] if moved else [F.col(f"_p{a}"), F.col(f"_c{a}")]), seed).alias(a) for a, seed in zip(AXES, seeds,
        strict=True)]
    label = F.coalesce("label", F.concat(F.lit("Community "), "community_id")).alias("label")
    return j.select("community_id", label, "size", *kept)


@dataclass
class Revision:
    """Tables of one immutable revision."""

    nodes: DataFrame
    members: DataFrame
    communities: DataFrame
    links: DataFrame
    routes: DataFrame
    bundles: DataFrame
    summary: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {"nodes": self.nodes, "members": self.members, "communities": self.communities, "links": self.links, "routes": self.routes,
            "bundles": self.bundles, "summary": self.summary}


def build_revision(
    built: Catalog, groups: DataFrame, active: DataFrame, relationships: DataFrame, previous: Revision | None = None, moved: bool = False, caps: dict[
        str, int | None] | None = None, most_nodes: int | None = NODES, most_links: int | None = LINKS
) -> Revision:
    """A revision over a catalog and communities (groups: id, group_id).

    Communities keep the ids of those of the previous revision that they match best;
    ones without a node in this revision are left out. Caps that are None (EVERY) leave nothing out.
    """
    caps = CAPS if caps is None else caps
    if any(n is not None and n < 1 for n in (most_nodes, most_links)) or any(n is not None and n < 0 for n in caps.values()):
        raise ValueError("caps must be positive")
    old = built.entities.limit(0).select("id", F.lit("").alias("group_id")) if previous is None else previous.members.select("id", F.col(
        "community_id").alias("group_id"))
    ids = staged(publish.stable_ids(old, groups), "revision-ids")
    every = groups.join(ids, "group_id").select("id", F.col("stable_id").alias("community_id"))
    nodes = staged(selected_nodes(built.entities, caps, most_nodes), "revision-nodes")
    members = staged(every.join(nodes.select("id"), "id", "left_semi"), "revision-members")
    found = landmarks(members, built.entities, None if previous is None else previous.communities, moved)
    found = staged(found, "revision-communities")
    # Nodes are entities, so what entities name needs no check against all of them before it meets the nodes.
    named = spatial.structural(built.entities)
    links = staged(projected_links(nodes, active, relationships, named, caps, most_links), "revision-links")
    first = publish.first_community(members)
    a, b = (first.select(F.col("id").alias(e), F.col("community_id").alias(f"c{e}")) for e in ("source", "target"))
    across = links.join(a, "source").join(b, "target").where("csource <> ctarget")
    routes = staged(across.groupBy(F.least("csource", "ctarget").alias("source"), F.greatest("csource", "ctarget")
        .alias("target")).agg(F.sum("weight").alias("weight")), "revision-routes")
    return Revision(nodes, members, found, links, routes, spatial.bundles(routes, found, 0.0), summary(nodes, links, found))


def summary(nodes: DataFrame, links: DataFrame, found: DataFrame) -> DataFrame:
    """One row: counts, bounds, and whether a revision is fit to be published."""
    n = spatial.bounds(nodes).withColumnRenamed("n", "n_nodes")
    one = n.crossJoin(links.agg(F.count("*").alias("n_links"))).crossJoin(found.agg(F.count("*").alias("n_communities")))  # one-row frames
    ok = (F.col("n_nodes") > 0) & (F.col("n_links") > 0) & (F.col("n_communities") > 0)
    for a in "xyz":
        ok = ok & (F.col(f"min_{a}") < F.col(f"max_{a}")) & (F.col(f"min_{a}") >= -catalog.FARTHEST) & (F.col(f"max_{a}") <= catalog.FARTHEST)
    return one.withColumn("passed", ok)


def passed(table: str) -> Callable[[dict[str, DataFrame]], bool]:
    """A gate: the table's one row has passed."""
    return lambda tables: bool(tables[table].first()["passed"])


def no_orphans(tables: dict[str, DataFrame]) -> bool:
    """A gate: every link's ends are nodes."""
    return integrity.orphan_links(tables["links"], tables["nodes"]).isEmpty()


def publish_revision(store: publish.Store, revision: Revision, keep: int = 5) -> str:
    """Write a revision, pass its gates, move the pointer, and drop old ones; its name."""
    store.gates = {"valid": passed("summary"), "no orphan links": no_orphans}
    name = store.publish(revision.tables())
    store.retain(keep)
    return name


def publish_catalog(store: publish.Store, built: Catalog, keep: int = 3) -> str:
    """The same for a catalog."""
    store.gates = {"valid": passed("report")}
    name = store.publish(built.tables())
    store.retain(keep)
    return name


# --- affinity builds


@dataclass
class AffinityBuild:
    """Fine communities (members: id, community_id), macro groups, and how both are presented."""

    pairs: DataFrame
    members: DataFrame
    macro: DataFrame
    communities: DataFrame
    watermark: str
    identities: dict[str, dict[str, str]] = field(default_factory=dict)


def presented(pairs: DataFrame, members: DataFrame, macro: DataFrame, names: DataFrame, texts: DataFrame, identities: dict[str, dict[str,
    str]]) -> DataFrame:
    """One row for each fine community with label, evidence, colours and shares.

    pairs: u, v, affinity. members: id, community_id. macro: id (a community), group_id.
    names: id, name. texts: id, text. identities: stable id and colour of each macro group.
    """
    ends = pairs.select(F.explode(F.array(F.struct(F.col("u").alias("id"), "affinity"), F.struct(F.col("v")
        .alias("id"), "affinity"))).alias("e")).select("e.*")
    strength = ends.groupBy("id").agg(F.sum("affinity").alias("strength"))
    known = members.join(strength, "id", "left").join(names, "id").withColumn("strength", F.coalesce("strength", F.lit(0.0)))
    told = staged(known, "presented-members")
    tops = scopes.representative_members(told.select(F.col("community_id").alias("group_id"), "id", "name", "strength"), told.select("name").limit(0))
    tops = tops.join(told.select("id", "name"), "id").groupBy("group_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", "name"))), lambda x: x["name"]).alias("representatives")
    )
    topics = search.topics(texts.join(members, "id").select(F.col("community_id").alias("group_id"), "text"), "group_id", [])
    labelled = scopes.labels(topics.select("group_id", "token", "rank"))
    mean = told.groupBy(F.col("community_id").alias("group_id")).agg(F.avg("strength").alias("mean"), F.count("*").alias("size"))
    graph = communities.community_graph(pairs, members).select("u", "v", F.col("weight").alias("affinity"))
    inner = members.select(F.col("id").alias("u"), F.col("community_id").alias("cu"))
    own = pairs.join(inner, "u").join(members.select(F.col("id").alias("v"), F.col("community_id").alias("cv")), "v").where("cu = cv").groupBy(
        F.col("cu").alias("u")).agg(F.sum("affinity").alias("affinity"))
    loops = own.select("u", F.col("u").alias("v"), (F.col("affinity") / 2).alias("affinity"))  # both ends of a loop count
    shares = affinity.macro_share(graph.unionByName(loops), macro).withColumnRenamed("id", "group_id").drop("is_bridge")
    place = layout.spectral(graph, macro).select(F.col("id").alias("group_id"), "position")
    look = F.create_map(*(x for g, v in identities.items() for x in (F.lit(g), F.struct(F.lit(v["stable_id"])
        .alias("macro_id"), F.lit(v["role"]).alias("colour")))))
    j = mean.join(macro.select(F.col("id").alias("group_id"), F.col("group_id").alias("macro")), "group_id")
    for extra in (labelled, tops, shares, place):
        j = j.join(extra, "group_id", "left")
    j = j.withColumns({"distinctiveness": distinctiveness(F.col("mean")), "confidence": confidence(F.col("size")), "_look": look[F.col(
        "macro").cast("string")]})
    bridge = is_bridge(F.coalesce("primary_share", F.lit(0.0)), F.coalesce("secondary_share", F.lit(0.0)))
    colour = shade(F.col("_look.colour"), F.coalesce("position", F.lit(0.0)), (F.col("distinctiveness") + F.col("confidence")) / 2)
    name = F.coalesce("label", F.array_join(F.slice("representatives", 1, 3), " · "), F.lit("Community"))
    return j.select(
        F.col("group_id").alias("community_id"), F.col("_look.macro_id").alias("macro_id"), name.alias("label"), F.array_join(F.slice(
            "representatives", 1, 3), " · ").alias("evidence"),
        "representatives", "size", "distinctiveness", "confidence", "primary_share", "secondary_share", bridge.alias("is_bridge"), colour.alias(
            "colour"), F.col("label").isNull().alias("fallback"), "fingerprint",
    )


def build_affinity(c: Corpus, watermark: str, per_node: int = 24, most: int = 1_000_000) -> AffinityBuild:
    """Communities and macro groups of the strongest affinities; raises Rejected where no resolution is fit."""
    scored = staged(affinity.affinity(c.activity, c.posts, c.cross_references), "affinity-pairs")
    pairs = scored.where("affinity > 0")
    kept = staged(ranking.strongest_edges(pairs.select("u", "v", F.col("affinity").alias("weight")), per_node, most), "affinity-kept")
    layers = affinity.layers_of(scored.join(kept.select("u", "v"), ["u", "v"], "left_semi"))
    fine = staged(communities.fine_selection(communities.multiplex_partitions(layers, list(communities.FINE))), "affinity-fine")
    if fine.isEmpty():
        raise publish.Rejected("no resolution gives communities that pass")
    members = fine.select("id", "community_id")
    strong = kept.select("u", "v", F.col("weight").alias("affinity"))
    graph = staged(communities.community_graph(strong, members), "affinity-graph")
    tried = communities.multiplex_partitions(graph.select(F.lit("affinity").alias("layer"), "u", "v", F.col("weight")
        .alias("raw"), F.lit(1.0).alias("weight")), list(communities.MACRO))
    macro = staged(macro_selection(tried), "affinity-macro")
    if macro.isEmpty():
        raise publish.Rejected(f"no resolution gives {MACRO_GROUPS[0]} to {MACRO_GROUPS[1]} macro groups")
    sized = macro.join(members.groupBy(F.col("community_id").alias("id")).agg(F.count("*").alias("size")), "id")
    identities = publish.macro_identities(sized.limit(0).withColumn("role", F.lit("")), sized)
    names = c.communities.select("id", "name")
    shown = presented(strong, members, macro, names, names.select("id", F.col("name").alias("text")), identities)
    return AffinityBuild(strong, members, macro, shown, watermark, identities)


def macro_selection(tried: DataFrame, groups: tuple[int, int] = MACRO_GROUPS) -> DataFrame:
    """id and group_id of the partition (resolution, id, community_id, modularity) with most modularity of those with a fit number of groups."""
    by = tried.groupBy("resolution").agg(F.count_distinct("community_id").alias("n"), F.max("modularity")
        .alias("q")).where(F.col("n").between(*groups))
    best = by.orderBy(F.desc("q"), "resolution").limit(1).select("resolution")
    return tried.join(F.broadcast(best), "resolution").select("id", F.col("community_id").alias("group_id"))  # best: one row


def promotion_gates(shown: DataFrame, groups: tuple[int, int] = MACRO_GROUPS, least: int = LEAST_COMMUNITIES) -> DataFrame:
    """One row: macro groups, the fewest communities of one, the part of fallback labels among the first landmarks, and whether all is well."""
    by = shown.groupBy("macro_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("n_groups"), F.coalesce(F.min("n"), F.lit(0)).alias("least"))
    first = shown.withColumn("_s", publish.landmark_score()).orderBy(F.desc("_s"), "community_id").limit(LANDMARKS)
    part = first.agg(F.coalesce(F.avg(F.col("fallback").cast("double")), F.lit(0.0)).alias("fallback_part"))
    ok = F.col("n_groups").between(*groups) & (F.col("least") >= least) & (F.col("fallback_part") < MOST_FALLBACK)
    return by.crossJoin(part).withColumn("passed", ok)  # one-row frames


def promote(revisions: publish.Store, built: Catalog, build: AffinityBuild, active: DataFrame, relationships: DataFrame, previous: Revision
    | None = None) -> str:
    """Publish a revision of an affinity build; raises Rejected at a gate, or where the catalog is of another time."""
    if built.watermark != build.watermark:
        raise publish.Rejected(f"the build is of {build.watermark}, the catalog of {built.watermark}")
    gates = promotion_gates(build.communities).first()
    if not gates["passed"]:
        raise publish.Rejected(f"promotion: {gates.asDict()}")
    groups = build.members.select(typed_id("community", "id").alias("id"), F.col("community_id").alias("group_id"))
    caps = {"community": NODES, "user": 0, "post": 0, "comment": 0}
    revision = build_revision(built, groups, active, relationships, previous, caps=caps)
    tables = revision.tables() | {"presented": build.communities}
    revisions.gates = {"valid": passed("summary"), "no orphan links": no_orphans}
    return revisions.publish(tables)


# --- reports


def collected(tables: dict[str, DataFrame], typed: DataFrame | None = None) -> DataFrame:
    """name, label and value of gauges: rows of each table, and nodes by type."""
    parts = [df.agg(F.count("*").alias("value")).select(F.lit("rows").alias("name"), F.lit(t).alias("label"), "value") for t, df in tables.items()]
    if typed is not None:
        parts.append(typed.groupBy(F.col("type").alias("label")).agg(F.count("*").alias("value")).select(F.lit("nodes")
            .alias("name"), "label", "value"))
    return reduce(DataFrame.unionByName, parts)


def version_record(versions: DataFrame, nodes: DataFrame, links: DataFrame, now: str, seconds: float) -> DataFrame:
    """The next version's row: its number, counts, how long it took and when."""
    next_ = versions.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id"))
    n = nodes.agg(F.count("*").alias("node_count")).crossJoin(links.agg(F.count("*").alias("link_count")))  # one-row frames
    return next_.crossJoin(n).select("id", "node_count", "link_count", F.lit("completed").alias("status"), F.lit(now)
        .cast("timestamp").alias("created_at"), F.lit(float(seconds)).alias("seconds"))


def numbered(rows: DataFrame, key: str, start: int) -> DataFrame:
    """Rows with ids from start on in the order of the key; meant for communities, of which there are few."""
    return rows.withColumn("id", F.row_number().over(Window.orderBy(key)) + start - 1)
