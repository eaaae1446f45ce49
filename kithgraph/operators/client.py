"""What an explorer computes over a scene: degrees, metrics, filters and densities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithgraph.functions.columns import weight
from kithgraph.operators.relational import degrees, links_among, tagged
from kithgraph.operators.spatial import bundle_weights, centroids


def _is(column: str, kind: str) -> F.Column:
    return F.col(column).startswith(f"{kind}_")


def active_users(links: DataFrame) -> DataFrame:
    """Different users linked with each community, either way."""
    a = links.where(_is("source", "user") & _is("target", "community")).select(F.col("target").alias("id"), F.col("source").alias("user"))
    b = links.where(_is("source", "community") & _is("target", "user")).select(F.col("source").alias("id"), F.col("target").alias("user"))
    return a.unionByName(b).groupBy("id").agg(F.count_distinct("user").alias("active_users"))


def community_links(links: DataFrame) -> DataFrame:
    """Links between communities, counted at both ends."""
    return degrees(links.where(_is("source", "community") & _is("target", "community"))).withColumnRenamed("degree", "n_links")


def content_activity(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Posts of each community and comments on those posts."""
    p = posts.select("id", "community_id")
    c = comments.groupBy("post_id").agg(F.count("*").alias("n_comments"))
    joined = p.join(c, F.col("id") == F.col("post_id"), "left")
    return joined.groupBy("community_id").agg((F.count("*") + F.sum(F.coalesce("n_comments", F.lit(0)))).alias("content"))


def user_metric(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """1.5 for a post and 1 for a comment."""
    both = posts.select("author_id", F.lit(1.5).alias("w")).unionByName(comments.select("author_id", F.lit(1.0).alias("w")))
    return both.groupBy("author_id").agg(F.sum("w").alias("metric"))


def with_degree(nodes: DataFrame, links: DataFrame, least: int, most: int) -> DataFrame:
    """Nodes with a degree in the range, and the links among them."""
    kept = nodes.join(degrees(links), "id", "left").where(F.coalesce("degree", F.lit(0)).between(least, most))
    return tagged(kept, links_among(links, kept))


def linked_only(nodes: DataFrame, links: DataFrame, exempt: str = "community") -> DataFrame:
    """Nodes with a link, and those of the exempt type; all nodes of a scene without links."""
    ends = links.select(F.explode(F.array("source", "target")).alias("id")).distinct().withColumn("_linked", F.lit(True))
    any_ = links.limit(1).agg((F.count("*") > 0).alias("_any"))
    found = nodes.join(ends, "id", "left").crossJoin(F.broadcast(any_))  # any: one row
    return found.where(~F.col("_any") | F.col("_linked") | F.coalesce(F.col("type") == exempt, F.lit(False))).select(*nodes.columns)


def render_cap(nodes: DataFrame, links: DataFrame, metric: DataFrame, most_nodes: int, most_links: int) -> DataFrame:
    """The nodes with the largest of degree (communities: their metric, of id and metric) and value, and the links among them."""
    ranked = nodes.join(degrees(links), "id", "left").join(metric.select("id", "metric"), "id", "left")
    drawn = F.when(F.col("type") == "community", F.coalesce("metric", F.lit(0))).otherwise(F.coalesce("degree", F.lit(0)))
    kept = ranked.withColumn("_w", F.greatest(drawn.cast("double"), weight().cast("double"))).orderBy(F.desc("_w"), "id").limit(most_nodes)
    return tagged(kept, links_among(links, kept, most_links))


def bundled_links(links: DataFrame, members: DataFrame, base: float = 1.0) -> DataFrame:
    """source, target, n_links, width and the centroids of both ends, for links (source, target) between communities of positioned members.

    The width grows with the logarithm of the number of links.
    """
    across = bundle_weights(links, members)
    centre = centroids(members).drop("n")
    a = centre.select(F.col("community_id").alias("source"), *(F.col(f"pos_{k}").alias(f"from_{k}") for k in "xyz"))
    b = centre.select(F.col("community_id").alias("target"), *(F.col(f"pos_{k}").alias(f"to_{k}") for k in "xyz"))
    j = across.join(a, "source").join(b, "target")
    return j.select("source", "target", F.col("weight").alias("n_links"), (base * (1 + F.log10("weight")))
        .alias("width"), *(f"{e}_{k}" for e in ("from", "to") for k in "xyz"))


def labels(nodes: DataFrame, links: DataFrame, most: int = 200) -> DataFrame:
    """Communities and users that get a label."""
    some = nodes.where(F.col("type").isin("community", "user")).join(degrees(links), "id", "left")
    return some.select("id", F.greatest(weight(), F.coalesce("degree", F.lit(0))).alias("value")).orderBy(F.desc("value"), "id").limit(most)


def density(links: DataFrame, members: DataFrame) -> DataFrame:
    """Links inside each community (id, community_id) over the possible pairs; zero under two members."""
    a = members.select(F.col("id").alias("source"), F.col("community_id").alias("cu"))
    b = members.select(F.col("id").alias("target"), F.col("community_id").alias("cv"))
    inner = links.join(a, "source").join(b, "target").where("cu = cv").groupBy(F.col("cu").alias("community_id")).agg(F.count("*")
        .alias("inner_links"))
    size = members.groupBy("community_id").agg(F.count("*").alias("n"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    found = size.join(inner, "community_id", "left")
    return found.select("community_id", "n", F.when(F.col("n") < 2, 0.0).otherwise(F.coalesce("inner_links", F.lit(0)) / pairs).alias("density"))
