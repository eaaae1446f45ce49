"""Search, catalog pages, facets, trees, threads and neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithgraph.functions.columns import by_weight, tokens, weight
from kithgraph.plans.staging import staged

#: Weights of a token by where it stands. Fixed values.
TITLE, DESCRIPTION, BODY = 1.0, 0.4, 0.2


def contains(nodes: DataFrame, query: str, most: int) -> DataFrame:
    """Nodes whose name or id holds the query in any case: exact names first, then exact ids, then by weight."""
    q = query.lower()
    found = nodes.where(F.lower("name").contains(q) | F.lower("id").contains(q))
    rank = F.when(F.lower("name") == q, 0).when(F.lower("id") == q, 1).otherwise(2)
    return found.withColumn("rank", rank).orderBy("rank", *by_weight()).limit(most)


def tiered(nodes: DataFrame, query: str, most: int) -> DataFrame:
    """Exact ids, exact labels (first 128 characters, any case), then prefixes; comments are left out."""
    head = F.lower(F.left("name", F.lit(128)))
    tier = F.when(F.col("id") == query, 2).when(head == query.lower(), 1).when(head.startswith(query.lower()), 0)
    return nodes.where(F.col("type") != "comment").withColumn("tier", tier).where("tier is not null").orderBy(F.desc("tier"), *by_weight()).limit(
        most)


def matching(docs: DataFrame, query: str, **filters: str | bool) -> DataFrame:
    """Documents (title, body, and filter columns) that hold all tokens of the query, or whose title contains it.

    Blank filters are no filters, so Catalyst only sees the predicates that count.
    """
    words = list(dict.fromkeys("".join(c if c.isalnum() else " " for c in query.lower()).split()))
    found = docs
    if words:
        held = tokens(F.concat_ws(" ", *(c for c in ("title", "description", "body") if c in docs.columns)))
        every = F.array_size(F.array_intersect(held, F.array(*map(F.lit, words)))) == len(words)
        found = found.where(every | F.lower("title").contains(query.lower()))
    for name, value in filters.items():
        if value != "":
            found = found.where(F.col(name) == value)
    return found


def relevance(query: str, described: bool = False) -> Column:
    """Weighted token hits, with a boost for exact titles and for prefixes; described: a description counts too."""
    words = F.array(*map(F.lit, dict.fromkeys("".join(c if c.isalnum() else " " for c in query.lower()).split())))
    hits = TITLE * F.array_size(F.array_intersect(tokens(F.col("title")), words)) + BODY * F.array_size(F.array_intersect(tokens(F.col(
        "body")), words))
    if described:
        hits = hits + DESCRIPTION * F.array_size(F.array_intersect(tokens(F.col("description")), words))
    return hits + F.when(F.lower("title") == query.lower(), 2.0).when(F.lower("title").startswith(query.lower()), 1.0).otherwise(0.0)


def catalog(docs: DataFrame, query: str, most: int, start: int = 0, **filters: str | bool) -> DataFrame:
    """A page of matching documents by relevance."""
    found = matching(docs, query, **filters).withColumn("relevance", relevance(query))
    return found.orderBy(F.desc("relevance"), "id").offset(start).limit(most)


#: What a catalog is sorted by, after which value and id decide.
SORTS = {"relevance": "relevance", "activity": "activity", "size": "value", "distinctiveness": "distinctiveness", "newest": "updated_at"}


def sorted_catalog(entities: DataFrame, query: str = "", sort: str | None = None, most: int = 50, start: int = 0, **filters: str | bool) -> DataFrame:
    """A page of entities (title, body, description, and columns of filters and sorts), by what is asked for.

    Without a sort: by relevance where there is a query, else by activity.
    """
    sort = sort or ("relevance" if query.strip() else "activity")
    if sort not in SORTS:
        raise ValueError(f"sort must be one of {', '.join(SORTS)}")
    found = matching(entities, query, **filters).withColumn("relevance", relevance(query, "description" in entities.columns) if query.strip()
        else F.lit(0.0))
    by = F.coalesce("activity", "value") if sort == "activity" else F.col(SORTS[sort])
    return found.orderBy(by.desc_nulls_last(), F.desc("value"), "id").offset(start).limit(most)


def facets(docs: DataFrame, query: str, by: str) -> DataFrame:
    return matching(docs, query).groupBy(by).agg(F.count("*").alias("n"))


def snippet(docs: DataFrame, most: int = 240) -> DataFrame:
    """The beginning of what isn't sensitive; characters, so none is cut in two."""
    text = F.substring(F.concat_ws(" ", "title", "body"), 1, most)
    return docs.select("id", F.when(~F.col("sensitive"), text).alias("snippet"))


def tree(comments: DataFrame, root: str) -> DataFrame:
    """One level under a parent, with the number of children of each."""
    children = comments.where(F.col("parent_id") == root)
    counts = comments.groupBy("parent_id").agg(F.count("*").alias("child_count"))
    under = F.concat(F.lit("t1_"), "id")
    joined = children.join(counts.select(F.col("parent_id").alias("_under"), "child_count"), under == F.col("_under"), "left")
    return joined.select("id", "score", F.coalesce("child_count", F.lit(0)).alias("child_count"))


def thread(turns: DataFrame, root: str, depth: int, most: int) -> DataFrame:
    """Descendants of a node (id, parent_id, value) to a depth, by depth and then value.

    One join for each level, of what is asked for three at most; nothing below the page's
    last level is looked for in vain, since each level starts from the ids of the one above.
    """
    level = turns.where(F.col("parent_id") == root).select("id", "value", F.lit(1).alias("depth"))
    out = level
    for d in range(2, depth + 1):
        above = level.select(F.col("id").alias("parent_id"))
        level = turns.join(above, "parent_id").select("id", "value", F.lit(d).alias("depth"))
        out = out.unionByName(level)
    return out.orderBy("depth", F.desc("value"), "id").limit(most)


def neighbourhood(links: DataFrame, root: str, most: int) -> DataFrame:
    """The root and what links with it either way (source, target, weight), strongest first."""
    out = links.where(F.col("source") == root).select(F.col("target").alias("id"), "weight")
    back = links.where(F.col("target") == root).select(F.col("source").alias("id"), "weight")
    found = out.unionByName(back).groupBy("id").agg(F.max("weight").alias("priority"))
    me = links.sparkSession.range(1).select(F.lit(root).alias("id"), F.lit(None).cast("bigint").alias("priority"))
    return found.unionByName(me).orderBy(F.desc_nulls_first("priority"), "id").limit(most)


def topics(docs: DataFrame, group: str, stop: list[str], most: int = 12) -> DataFrame:
    """The tokens of three letters and more with the highest tf-idf in each group of texts."""
    from pyspark.sql import Window

    words = docs.select(group, F.explode(tokens(F.col("text"))).alias("token")).where((F.length("token") >= 3) & ~F.col("token").isin(*stop))
    tf = words.groupBy(group, "token").agg(F.count("*").alias("tf"))
    df = tf.groupBy("token").agg(F.count("*").alias("df"))
    n = docs.agg(F.count_distinct(group).alias("n"))
    scored = tf.join(df, "token").crossJoin(F.broadcast(n)).withColumn("score", F.col("tf") * F.ln((1 + F.col("n")) / (1 + F.col("df"))))  # n: one row
    w = Window.partitionBy(group).orderBy(F.desc("score"), "token")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select(group, "token", "score", "rank")


def lateral_top_links(links: DataFrame, visible: DataFrame, most: int) -> DataFrame:
    """The strongest links (source, target, weight) between visible nodes, by way of the strongest of each source.

    No source has more among the result than the limit, so taking as many of each loses none.
    """
    from kithgraph.operators.ranking import first_by

    mine = links.join(visible.select(F.col("id").alias("source")), "source", "left_semi").join(visible.select(F.col("id")
        .alias("target")), "target", "left_semi")
    kept = first_by(mine, ["source"], [F.desc("weight"), F.asc("target")], most)
    return kept.select("source", "target", "weight").orderBy(F.desc("weight"), "source", "target").limit(most)


def sitemap(entities: DataFrame, per_shard: int) -> DataFrame:
    """shard, its entries and latest day, of entities (id, updated_at) by id.

    Shards are cut by ranks; the rank of a row is taken within ranges of ids and carried on by their sizes.
    """
    from pyspark.sql import Window

    # Staged, so that a row's range is the same wherever it is read.
    ranged = staged(entities.select("id", "updated_at").repartitionByRange("id").withColumn("_part", F.spark_partition_id()), "sitemap")

    sizes = ranged.groupBy("_part").agg(F.count("*").alias("n")).withColumn("_off", F.sum("n").over(Window.orderBy("_part")) - F.col("n"))  # one row a partition
    placed = ranged.withColumn("_nth", F.row_number().over(Window.partitionBy("_part").orderBy("id"))).join(F.broadcast(sizes), "_part")  # one row a partition
    shard = F.floor((F.col("_off") + F.col("_nth") - 1) / per_shard).cast("int")
    return placed.groupBy(shard.alias("shard")).agg(F.count("*").alias("entries"), F.max(F.to_date("updated_at")).alias("updated"))


def heaviest(nodes: DataFrame, kinds: list[str], most: int) -> DataFrame:
    return nodes.where(F.col("type").isin(*kinds)).select("id", weight().alias("value")).orderBy(F.desc("value"), "id").limit(most)
