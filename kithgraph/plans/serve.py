"""The read API: bounded queries over one revision's tables, with their defaults and ceilings.

A method returns a DataFrame; nothing is computed before an action. Suppressed entities
never appear. Cursors are opaque strings, checked against what they were made for.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithgraph.functions.cursors import decode_keyset, page_limit, sign, verify
from kithgraph.operators import integrity, ranking, relational, scopes, search, spatial
from kithgraph.sources import exports

#: Default and ceiling of each bounded read. Fixed values.
LIMITS = {
    "nodes": (20_000, 50_000),
    "links": (50_000, 100_000),
    "page": (1_000, 50_000),
    "region_nodes": (10_000, 25_000),
    "region_links": (50_000, 50_000),
    "overview": (100, 2_000),
    "search": (50, 500),
    "catalog": (50, 200),
    "communities": (50, 200),
    "thread": (50, 250),
    "neighbours": (20, 100),
    "top": (10, 100),
}


def limit(kind: str, asked: int | None) -> int:
    return page_limit(asked, *LIMITS[kind])


@dataclass
class Explorer:
    """Reads over a revision: nodes (id, name, val, type), links (source, target), and what the other reads name."""

    nodes: DataFrame
    links: DataFrame
    entities: DataFrame | None = None
    landmarks: DataFrame | None = None
    routes: DataFrame | None = None
    documents: DataFrame | None = None
    positions: DataFrame | None = None
    suppressed: DataFrame | None = None
    revision: str = "workspace"
    catalog_id: str = "none"
    secret: bytes = field(default=b"", repr=False)

    def _visible(self, rows: DataFrame) -> DataFrame:
        return rows if self.suppressed is None else spatial.visible(rows, self.suppressed)

    def graph(self, max_nodes: int | None = None, max_links: int | None = None, types: list[str] | None = None) -> DataFrame:
        """The heaviest nodes and the links among them; no types at all give an empty graph."""
        kinds = None if types is None else sorted({t.strip().lower() for t in types if t.strip()})
        return relational.capped_graph(self._visible(self.nodes), self.links, limit("nodes", max_nodes), limit("links", max_links), kinds)

    def graph_page(self, size: int | None = None, cursor: str | None = None, types: list[str] | None = None) -> DataFrame:
        """A page of nodes after a cursor, one row more than asked for; types are filtered before the page is cut."""
        rows = self._visible(self.nodes)
        if types is not None:
            rows = rows.where(F.col("type").isin(*types))
        return ranking.keyset_page(rows, limit("page", size), decode_keyset(cursor) if cursor else None)

    def region(self, bounds: tuple[float, float, float, float, float, float], detail: str = "medium", most: int | None = None, start: int = 0) -> DataFrame:
        empty = self.positions.limit(0).select(F.col("id").alias("entity_id"), F.lit(None).cast("timestamp").alias("restored_at"))
        return spatial.region(self.positions, self.suppressed if self.suppressed is not None else empty, bounds, detail, limit(
            "region_nodes", most), start)

    def overview(self, most: int | None = None) -> DataFrame:
        n = limit("overview", most)
        return scopes.overview(self.landmarks, self.routes, n, n)

    def communities(self, size: int | None = None, start: int = 0) -> DataFrame:
        return scopes.communities_page(self.landmarks, limit("communities", size), start)

    def search(self, query: str, most: int | None = None) -> DataFrame:
        return search.tiered(self._visible(self.nodes), query, limit("search", most))

    def search_anywhere(self, query: str, most: int | None = None) -> DataFrame:
        return search.contains(self._visible(self.nodes), query, limit("search", most))

    def catalog(self, query: str = "", size: int | None = None, cursor: str | None = None, **filters: str) -> DataFrame:
        start = int(verify(self.secret, cursor, self.revision, self.catalog_id, {"q": query, **filters})["start"]) if cursor else 0
        return search.catalog(self._visible(self.documents), query, limit("catalog", size), start, **filters)

    def catalog_cursor(self, start: int, query: str = "", **filters: str) -> str:
        """Where the next page of the same query begins."""
        return sign(self.secret, self.revision, self.catalog_id, {"q": query, **filters}, {"start": start})

    def facets(self, by: str, query: str = "") -> DataFrame:
        return search.facets(self._visible(self.documents), query, by)

    def scene(self, community: str, kinds: list[str], most: int | None = None) -> DataFrame:
        hidden = self.suppressed if self.suppressed is not None else self.entities.limit(0).select(F.col("id")
            .alias("entity_id"), F.lit(None).cast("timestamp").alias("restored_at"))
        return scopes.community_scene(self.entities, hidden, community, kinds, limit("region_nodes", most))

    def thread(self, root: str, depth: int = 3, most: int | None = None) -> DataFrame:
        """Descendants of an entity, three levels at most."""
        rows = self._visible(self.entities).select("id", "parent_id", "value")
        return search.thread(rows, root, min(max(1, depth), 3), limit("thread", most))

    def neighbours(self, node: str, most: int | None = None) -> DataFrame:
        return relational.neighbours(self._visible(self.nodes), self.links, node, limit("neighbours", most))

    def details(self, node: str, most: int | None = None) -> DataFrame:
        return scopes.node_details(self._visible(self.nodes).select("id", F.col("name").alias("label")), self.links, node, limit("neighbours", most))

    def top(self, kinds: list[str], most: int | None = None) -> DataFrame:
        return search.heaviest(self._visible(self.nodes), kinds, limit("top", most))

    def changes(self, before: Explorer) -> DataFrame:
        """What was added and removed since another revision."""
        return integrity.one_sided(before.nodes, self.nodes, "id")

    def document(self, max_nodes: int | None = None, max_links: int | None = None) -> DataFrame:
        """The capped graph as one JSON document."""
        kept = relational.top_nodes(self._visible(self.nodes), limit("nodes", max_nodes))
        return exports.graph_json(kept, relational.links_among(self.links, kept, limit("links", max_links)))
