"""Sinks and text sources: JSON, CSV and line-delimited exports, embedded lists, flattened trees."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def graph_json(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """One document {nodes, links} of a graph that the caller has capped; graph_json_pieces() takes any."""
    n = nodes.agg(F.array_sort(F.collect_list(F.struct("id", "name", "val", "type"))).alias("nodes"))
    l_ = links.agg(F.array_sort(F.collect_list(F.struct("source", "target"))).alias("links"))
    return n.crossJoin(l_).select(F.to_json(F.struct("nodes", "links")).alias("document"))  # one-row frames


def graph_json_pieces(nodes: DataFrame, links: DataFrame, size: int = 1_000) -> DataFrame:
    """kind, place and piece: the document {nodes, links} of a graph of any size, in pieces of a bounded number of elements.

    A piece is a JSON array of neighbours in the order of ids or ends. Pieces of a kind joined
    in the order of their places, brackets between them made commas, are that kind's array,
    so no task holds the document and no row outgrows what a value can hold.
    """
    parts = [
        nodes.select(F.lit("nodes").alias("kind"), F.to_json(F.struct("id", "name", "val", "type")).alias("text"), F.col("id").alias("_a"), F.lit(
            "").alias("_b")),
        links.select(F.lit("links").alias("kind"), F.to_json(F.struct("source", "target")).alias("text"), F.col("source").alias("_a"), F.col(
            "target").alias("_b")),
    ]
    schema = "kind string, place long, piece string"

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held, last = TaskContext.get().partitionId(), 0, [], None

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"kind": [last], "place": [(part << 32) + n], "piece": ["[" + ",".join(held) + "]"]})

        for b in batches:
            for kind, text in zip(b.column("kind").to_pylist(), b.column("text").to_pylist(), strict=True):
                if held and (kind != last or len(held) == size):
                    yield piece()
                    n, held = n + 1, []
                last = kind
                held.append(text)
        if held:
            yield piece()

    ordered = reduce(DataFrame.unionByName, parts).orderBy("kind", "_a", "_b")
    return ordered.select("kind", "text").mapInArrow(kernel, schema)


def csv_rows(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Rows of the CSV export."""
    n = nodes.select(F.lit("node").alias("data_type"), "id", "name", "val", "type")
    l_ = links.select(F.lit("link").alias("data_type"), "source", "target")
    return n.unionByName(l_, allowMissingColumns=True).select("data_type", "id", "name", "val", "type", "source", "target")


def write_csv(nodes: DataFrame, links: DataFrame, path: str) -> None:
    csv_rows(nodes, links).write.mode("overwrite").csv(path, header=True)


def ndjson_rows(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """kind and line: an envelope for each node and link, then the counts."""
    n = nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct(F.lit("node").alias("kind"), "id", "name", "val", "type")).alias("line"))
    l_ = links.select(F.lit("link").alias("kind"), F.to_json(F.struct(F.lit("link").alias("kind"), "source", "target")).alias("line"))
    counts = nodes.agg(F.count("*").alias("nodes")).crossJoin(links.agg(F.count("*").alias("links")))  # one-row frames
    return n.unionByName(l_).unionByName(counts.select(F.lit("meta").alias("kind"), F.to_json(F.struct(F.lit("meta")
        .alias("kind"), "nodes", "links")).alias("line")))


def write_ndjson(nodes: DataFrame, links: DataFrame, path: str) -> None:
    ndjson_rows(nodes, links).select("line").write.mode("overwrite").text(path)


def name_list(spark: SparkSession, path: str) -> DataFrame:
    """Names of a text file with one on each line: trimmed, lower-cased, without repeats, and the file's sha-256."""
    lines = spark.read.text(path, wholetext=True)
    body = lines.select(F.sha2("value", 256).alias("sha256"), F.explode(F.split("value", "\n")).alias("name"))
    return body.select(F.lower(F.trim("name")).alias("name"), "sha256").where("name <> ''").distinct()


def flattened(replies: DataFrame, most_depth: int) -> DataFrame:
    """id, parent_id, depth and flags of nested replies (raw: JSON text of {id, body, replies: [...]}), level by level.

    The depth is bounded, so the plan is too; no level is collected.
    """
    level = replies.select(F.col("raw"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("depth"))
    out = None
    for depth in range(most_depth + 1):
        rows = level.select(F.get_json_object("raw", "$.id").alias("id"), "parent_id", F.lit(depth).alias("depth"), F.get_json_object("raw",
            "$.body").alias("body"), F.get_json_object("raw", "$.replies").alias("replies"))
        flat = rows.select("id", "parent_id", "depth", "body", (F.col("body") == "[removed]").alias("removed"), (F.col("body") == "[deleted]")
            .alias("deleted"))
        out = flat if out is None else out.unionByName(flat)
        # Members of a JSON array as texts of their own.
        inner = F.explode(F.from_json("replies", "array<string>"))
        level = rows.where("replies is not null").select(F.col("id").alias("parent_id"), inner.alias("raw"))
    return out
