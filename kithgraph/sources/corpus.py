"""The community corpus: a typed model over the source tables, as lazy DataFrames.

Suppliers are communities, customers are users, orders are posts and their lines are
comments (each the reply to the line before). Only columns that an operator asks for
are read, and filters reach the Parquet scans.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kithgraph.functions.columns import typed_id

#: Communities with at least this many common users are linked.
LEAST_OVERLAP = 2


class Corpus:
    """Tables of one source folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def communities(self) -> DataFrame:
        subscribers = F.greatest(F.col("s_acctbal").cast("int"), F.lit(0))
        return self.table("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), subscribers.alias("subscribers"),
            F.col("s_nationkey").alias("nation"))

    @cached_property
    def users(self) -> DataFrame:
        return self.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"))

    @cached_property
    def lines(self) -> DataFrame:
        """Order lines with their place in the order; equal lines are interchangeable."""
        order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"]
        names = ["l_orderkey", *order, "l_returnflag", "l_linestatus"]
        return self.table("lineitem").select(*names).withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)))

    @cached_property
    def all_posts(self) -> DataFrame:
        """Posts, those without a community (orders without lines) included."""
        # The first line by aggregation, which needs neither a window nor a sort of all lines.
        order = F.struct("l_linenumber", "l_partkey", "l_suppkey")
        first = self.table("lineitem").groupBy("l_orderkey").agg(F.min(order).alias("first")).select("l_orderkey", F.col("first.l_suppkey")
            .alias("l_suppkey"))
        title = F.concat_ws(" ", "o_orderpriority", "o_orderstatus")
        orders = self.table("orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", title.alias("title"))
        return orders.join(first, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
            F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("author_id"), F.col("l_suppkey").alias("community_id"), "title", (F.col(
                "o_totalprice") / 1000).cast("int").alias("score"), F.col("o_orderdate").alias("created_at")
        )

    @cached_property
    def posts(self) -> DataFrame:
        return self.all_posts.where("community_id is not null")

    @cached_property
    def comments(self) -> DataFrame:
        owner = self.table("orders").select("o_orderkey", "o_custkey")
        key = F.concat_ws("_", "l_orderkey", "n")
        parent = F.when(F.col("n") == 1, F.concat(F.lit("t3_"), F.col("l_orderkey").cast("string"))).otherwise(F.concat(F.lit("t1_"), F.col(
            "l_orderkey").cast("string"), F.lit("_"), (F.col("n") - 1).cast("string")))
        return self.lines.join(owner, F.col("l_orderkey") == F.col("o_orderkey")).select(
            key.alias("id"), F.col("l_orderkey").alias("post_id"), F.col("o_custkey").alias("author_id"), F.col("l_suppkey").alias(
                "community_id"), parent.alias("parent_id"),
            F.concat_ws(" ", F.lit("flag"), "l_returnflag", F.lit("status"), "l_linestatus").alias("body"), F.col("l_quantity").cast("int").alias(
                "score"), (F.col("n") - 1).cast("int").alias("depth"), F.col("l_shipdate").alias("created_at"),
        )

    @cached_property
    def overrides(self) -> DataFrame:
        """user_id and automated of users classified by hand; the source tables have none."""
        return self.users.limit(0).select(F.col("id").alias("user_id"), F.lit(False).alias("automated"))

    @cached_property
    def cross_references(self) -> DataFrame:
        """Consecutive lines of an order from different communities."""
        w = Window.partitionBy("l_orderkey").orderBy("n")
        steps = self.lines.select("l_orderkey", F.col("l_suppkey").alias("source"), F.lead("l_suppkey")
            .over(w).alias("target"), F.lead("l_shipdate").over(w).alias("observed_at"))
        return steps.where("target is not null and source <> target").select(F.col("l_orderkey").alias("post_id"), "source", "target", "observed_at")

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events")

    @cached_property
    def points(self) -> DataFrame:
        """Embeddings as nodes with positions."""
        kind = F.element_at(F.array(*(F.lit(t) for t in ("community", "user", "post", "comment"))), (F.col("vec_id") % 4 + 1).cast("int"))
        axis = [F.element_at("embedding", k + 1).cast("double").alias(f"pos_{a}") for k, a in enumerate("xyz")]
        return self.table("embeddings").select(typed_id("point", "vec_id").alias("id"), F.concat(F.lit("P"), F.col("vec_id")
            .cast("string")).alias("name"), (F.col("vec_id") * 7 % 1000).cast("string").alias("val"), kind.alias("type"), F.col("label")
            .alias("community_id"), *axis)

    @cached_property
    def activity(self) -> DataFrame:
        from kithgraph.operators.relational import activity

        return activity(self.posts, self.comments)

    @cached_property
    def kept_activity(self) -> DataFrame:
        """activity as a written table, for plans that read it several times."""
        from kithgraph.plans.staging import staged

        return staged(self.activity, "activity")

    @cached_property
    def relationships(self) -> DataFrame:
        from kithgraph.operators.relational import overlaps

        return overlaps(self.kept_activity, LEAST_OVERLAP)

    @cached_property
    def kept_relationships(self) -> DataFrame:
        """relationships as a written table; their self-join is the costliest step of plans that read them several times."""
        from kithgraph.plans.staging import staged

        return staged(self.relationships, "relationships")

    @cached_property
    def nodes(self) -> DataFrame:
        """id, name, val (text) and type of communities, users and posts."""
        total = self.kept_activity.groupBy("user_id").agg(F.sum("activity_count").alias("total"))
        users = self.users.join(total, F.col("id") == F.col("user_id"), "left")
        parts = [
            self.communities.select(typed_id("community", "id").alias("id"), "name", F.col("subscribers")
                .cast("string").alias("val"), F.lit("community").alias("type")),
            users.select(typed_id("user", "id").alias("id"), F.col("username").alias("name"), F.coalesce("total", F.lit(0))
                .cast("string").alias("val"), F.lit("user").alias("type")),
            self.posts.select(typed_id("post", "id").alias("id"), F.col("title").alias("name"), F.col("score")
                .cast("string").alias("val"), F.lit("post").alias("type")),
        ]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    @cached_property
    def links(self) -> DataFrame:
        """source and target: users and communities, communities both ways, posts and communities."""
        parts = [
            self.kept_activity.select(typed_id("user", "user_id").alias("source"), typed_id("community", "community_id").alias("target")),
            self.relationships.select(typed_id("community", "source").alias("source"), typed_id("community", "target").alias("target")),
            self.posts.select(typed_id("post", "id").alias("source"), typed_id("community", "community_id").alias("target")),
        ]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])
