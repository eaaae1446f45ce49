"""Publishing immutable revisions: staged tables, gates, and a pointer that moves last."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kithgraph.operators.communities import PALETTE, palette_roles
from kithgraph.operators.ranking import first_by, mutual_best

#: Nodes of each type in a revision. Fixed values.
QUOTAS = {"community": 70_000, "user": 30_000, "post": 0, "comment": 0}


#: Macro groups that can be told apart; a build that is published has a dozen at most.
MOST_GROUPS = 1_000


class Rejected(RuntimeError):
    """A revision that fails a gate; the pointer still names the one before."""


@dataclass
class Store:
    """Revisions under one folder of any file system that Spark writes to."""

    spark: SparkSession
    root: str
    gates: dict[str, Callable[[dict[str, DataFrame]], bool]] = field(default_factory=dict)

    def _path(self, *parts: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path("/".join([self.root.rstrip("/"), *parts]))
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _pointers(self) -> list[int]:
        root, fs = self._path()
        if not fs.exists(root):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(root) if s.isFile())
        return sorted(int(n[8:-5]) for n in names if n.startswith("current-") and n.endswith(".json") and n[8:-5].isdigit())

    def current(self) -> str | None:
        """What the newest pointer names."""
        found = self._pointers()
        if not found:
            return None
        path, _ = self._path(f"current-{found[-1]}.json")
        return json.loads(self.spark.read.text(str(path.toString()), wholetext=True).first()[0])["revision"]

    def publish(self, tables: dict[str, DataFrame]) -> str:
        """Write all tables, read them back through the gates, then write the next pointer."""
        revision = uuid.uuid4().hex
        for name, df in tables.items():
            df.write.parquet(f"{self.root.rstrip('/')}/{revision}/{name}")
        written = {name: self.read(name, revision) for name in tables}
        for gate, holds in self.gates.items():
            if not holds(written):
                path, fs = self._path(revision)
                fs.delete(path, True)
                raise Rejected(gate)
        self._point(revision)
        return revision

    def _point(self, revision: str) -> None:
        """A new pointer, written under another name and renamed to the next number; the one before stays until then."""
        new, fs = self._path(f"pointer-{revision}-{uuid.uuid4().hex}.tmp")
        out = fs.create(new, False)
        out.write(bytearray(json.dumps({"revision": revision}).encode()))
        out.close()
        found = self._pointers()
        number = found[-1] + 1 if found else 1
        pointer, _ = self._path(f"current-{number}.json")
        if fs.exists(pointer) or not fs.rename(new, pointer):
            fs.delete(new, False)
            raise Rejected("another publication came first")
        for old in found[:-8]:  # readers that listed them may still open the last few
            path, _ = self._path(f"current-{old}.json")
            fs.delete(path, False)

    def rollback(self, revision: str) -> None:
        """Point to a revision that is still there."""
        path, fs = self._path(revision)
        if not fs.exists(path):
            raise Rejected(f"no revision {revision}")
        self._point(revision)

    def read(self, name: str, revision: str | None = None) -> DataFrame:
        revision = revision or self.current()
        if revision is None:
            raise LookupError("nothing is published")
        return self.spark.read.parquet(f"{self.root.rstrip('/')}/{revision}/{name}")

    def retain(self, keep: int) -> list[str]:
        """Drop all but the newest revisions; never the current one."""
        root, fs = self._path()
        found = sorted(((s.getModificationTime(), s.getPath().getName()) for s in fs.listStatus(root) if s.isDirectory()), reverse=True)
        gone = [name for _, name in found[keep:] if name != self.current()]
        for name in gone:
            path, _ = self._path(name)
            fs.delete(path, True)
        return gone


def typed_projection(entities: DataFrame, active: DataFrame, relationships: DataFrame, links: DataFrame, cap: int) -> DataFrame:
    """source, target, relation, directed and weight of all kinds of links between entities, the heaviest first."""
    from kithgraph.functions.columns import typed_id
    from kithgraph.operators.relational import overlap_projection

    o = overlap_projection(relationships)
    parts = [
        active.select(typed_id("user", "user_id").alias("source"), typed_id("community", "community_id")
            .alias("target"), F.lit("user_activity").alias("relation"), F.lit(True).alias("directed"), F.col("activity_count")
            .cast("long").alias("weight")),
        o.select(typed_id("community", "u").alias("source"), typed_id("community", "v").alias("target"), F.lit("overlap")
            .alias("relation"), F.lit(False).alias("directed"), F.col("weight").cast("long").alias("weight")),
        links.select("source", "target", "relation", F.lit(True).alias("directed"), F.lit(1).cast("long").alias("weight")),
    ]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    keys = entities.select("id")
    held = both.join(keys.withColumnRenamed("id", "source"), "source", "left_semi").join(keys.withColumnRenamed("id", "target"), "target",
        "left_semi")
    return held.select("source", "target", "relation", "directed", "weight").orderBy(F.desc("weight"), "source", "target", "relation").limit(cap)


def matched(old: DataFrame, new: DataFrame, subscribers: DataFrame | None = None) -> DataFrame:
    """new_id, old_id and weight: groups of two builds (id, group_id) that are each other's best by common members.

    With subscribers (id, subscribers) a member weighs 1 + ln(1 + subscribers), else 1.
    """
    both = new.select("id", F.col("group_id").alias("new_id")).join(old.select("id", F.col("group_id").alias("old_id")), "id")
    if subscribers is None:
        return mutual_best(both.groupBy("new_id", "old_id").agg(F.count("*").alias("weight")))
    known = both.join(subscribers.select("id", "subscribers"), "id", "left")
    weight = F.greatest(F.lit(1.0), 1 + F.log1p(F.greatest(F.coalesce("subscribers", F.lit(0)), F.lit(0))))
    return mutual_best(known.groupBy("new_id", "old_id").agg(F.round(F.sum(weight), 9).alias("weight")))


def stable_ids(old: DataFrame, new: DataFrame, subscribers: DataFrame | None = None, prefix: str = "c:new:") -> DataFrame:
    """group_id and stable_id of a new build: the old id of its match, else a digest of its members.

    The digest is of the members' number and of sums of their hashes, so no group is gathered.
    """
    h, g = F.xxhash64(F.col("id").cast("string")), F.xxhash64(F.lit("g"), F.col("id").cast("string"))
    digest = new.groupBy("group_id").agg(F.sha2(F.concat_ws(":", F.count("*"), F.bit_xor(h), F.sum(g.cast("decimal(38, 0)"))), 256).alias("_d"))
    m = matched(old, new, subscribers).select(F.col("new_id").alias("group_id"), F.col("old_id").cast("string").alias("_old"))
    return digest.join(m, "group_id", "left").select("group_id", F.coalesce("_old", F.concat(F.lit(prefix), F.left("_d", F.lit(16))))
        .alias("stable_id"))


def macro_identities(old: DataFrame, new: DataFrame) -> dict[str, dict[str, str]]:
    """Stable id and palette role of each macro group of a build, of at most a few dozen.

    old has group_id, role, and the fine communities (id) and sizes (size) it held; new has
    group_id, id and size. Groups match by the members of common communities; a new one
    takes the first role that is free.
    """
    both = new.select("id", F.col("group_id").alias("new_id"), "size").join(old.select("id", F.col("group_id").alias("old_id")), "id")
    m = mutual_best(both.groupBy("new_id", "old_id").agg(F.sum("size").alias("weight")))
    ids = stable_ids(old.limit(0), new, prefix="m:new:").join(m.select(F.col("new_id").alias("group_id"), F.col("old_id")
        .cast("string").alias("_old")), "group_id", "left")
    roles = old.groupBy(F.col("group_id").cast("string").alias("_old")).agg(F.min("role").alias("role"))
    named = ids.join(roles, "_old", "left").select("group_id", F.coalesce("_old", "stable_id").alias("stable_id"), "role")
    rows = named.orderBy("group_id").limit(MOST_GROUPS + 1).collect()
    if len(rows) > MOST_GROUPS:
        raise ValueError(f"over {MOST_GROUPS} macro groups, which no palette tells apart")
    kept = {r["stable_id"]: r["role"] for r in rows if r["role"] is not None}
    given = palette_roles([r["stable_id"] for r in rows], kept)
    return {str(r["group_id"]): {"stable_id": r["stable_id"], "role": given[r["stable_id"]]} for r in rows}


def landmark_score(size: str = "size", distinct: str = "distinctiveness", confidence: str = "confidence", bridge: str = "is_bridge") -> F.Column:
    """How much a community deserves a place in the overview."""
    return 0.30 * F.log1p(F.col(size)) + 0.30 * F.col(distinct) + 0.25 * F.col(confidence) + 0.15 * F.col(bridge).cast("double")


def representative_clusters(landmarks: DataFrame, most: int = 12) -> DataFrame:
    """The most telling communities of each macro group, in order."""
    w = Window.partitionBy("macro_id").orderBy(F.desc("distinctiveness"), F.desc("confidence"), "id")
    kept = landmarks.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
    return kept.groupBy("macro_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.col("id")
        .cast("string").alias("id")))), lambda x: x["id"]), ",").alias("clusters"))


def first_community(members: DataFrame) -> DataFrame:
    """The smallest community of each node."""
    return members.groupBy("id").agg(F.min("community_id").alias("community_id"))


def newest(rows: DataFrame, key: str, at: str) -> DataFrame:
    """The latest event of each key, such as whether an entity is suppressed."""
    return first_by(rows, [key], [F.desc(at)])
