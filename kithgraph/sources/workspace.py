"""Tables that change: keyed upserts, inserts, deletes and truncation over Parquet, a version of a table at a time.

A change writes the table's next version and then makes it the newest by a rename, so
readers see a whole version, the old or the new one. Writers of one table take turns; the
one that comes second to a version fails and may try again.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Versions of a table that are kept for readers.
KEPT = 3


class Conflict(RuntimeError):
    """Another writer made this version first."""


@dataclass
class Workspace:
    """Tables under a folder of any file system that Spark writes to."""

    spark: SparkSession
    root: str

    def _fs(self, *parts: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.root.rstrip("/"), *parts]))
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self, table: str) -> list[int]:
        path, fs = self._fs(table)
        if not fs.exists(path):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory())
        return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit())

    def read(self, table: str) -> DataFrame:
        found = self.versions(table)
        if not found:
            raise LookupError(f"no table {table}")
        return self.spark.read.parquet(f"{self.root.rstrip('/')}/{table}/v{found[-1]}")

    def replace(self, table: str, rows: DataFrame) -> int:
        """The table's next version; its number."""
        found = self.versions(table)
        number = found[-1] + 1 if found else 1
        folder, fs = self._fs(table)
        fs.mkdirs(folder)
        made, _ = self._fs(table, f"_made-{uuid.uuid4().hex}")
        rows.write.parquet(made.toString())
        target, _ = self._fs(table, f"v{number}")
        if fs.exists(target) or not fs.rename(made, target):
            fs.delete(made, True)
            raise Conflict(f"{table} has a version {number}")
        for old in found[: -(KEPT - 1)]:
            fs.delete(self._fs(table, f"v{old}")[0], True)
        return number

    def upsert(self, table: str, rows: DataFrame, keys: list[str], order: Column | None = None, touch: str | None = None, now: str | None = None) -> int:
        """Rows replace those of their keys; of several with one key the last by order. touch is set to `now` where a row changes."""
        new = last_by_key(rows, keys, F.lit(0) if order is None else order)
        if not self.versions(table):
            return self.replace(table, new if touch is None else new.withColumn(touch, F.lit(now).cast("timestamp")))
        return self.replace(table, upserted(self.read(table), new, keys, touch, now))

    def insert(self, table: str, rows: DataFrame, keys: list[str]) -> int:
        """Rows whose keys are not there yet; of several with one key one."""
        new = rows.dropDuplicates(keys)
        if not self.versions(table):
            return self.replace(table, new)
        old = self.read(table)
        return self.replace(table, old.unionByName(new.join(old.select(*keys), keys, "left_anti").select(*old.columns)))

    def append(self, table: str, rows: DataFrame) -> int:
        return self.replace(table, self.read(table).unionByName(rows) if self.versions(table) else rows)

    def delete(self, table: str, keys: DataFrame) -> int:
        """Without the rows of these keys (columns of the table)."""
        return self.replace(table, self.read(table).join(keys, keys.columns, "left_anti"))

    def truncate(self, table: str) -> int:
        return self.replace(table, self.read(table).limit(0))


def last_by_key(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row for each key, the last by order."""
    w = Window.partitionBy(*keys).orderBy(order.desc())
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def upserted(old: DataFrame, new: DataFrame, keys: list[str], touch: str | None = None, now: str | None = None) -> DataFrame:
    """old with new rows in place of those of their keys. touch, a time, moves to `now` only where a row differs."""
    values = [c for c in new.columns if c not in keys and c != touch]
    renamed = new.select(*(F.col(k) for k in keys), *(F.col(c).alias(f"_new_{c}") for c in values), F.lit(True).alias("_has"))
    j = old.join(renamed, keys, "full_outer")
    has = F.coalesce("_has", F.lit(False))
    out = {c: F.when(has, F.col(f"_new_{c}")).otherwise(F.col(c)) for c in values}
    if touch is not None:
        same = F.lit(True)
        for c in values:
            same = same & F.col(c).eqNullSafe(F.col(f"_new_{c}"))
        out[touch] = F.when(has & ~(same & F.col(touch).isNotNull()), F.lit(now).cast("timestamp")).otherwise(F.col(touch))
    return j.select(*(out[c].alias(c) if c in out else F.col(c) for c in old.columns))


def audited(action: str, kind: str, user: str, now: str, rows: DataFrame) -> DataFrame:
    """Audit rows for resources (resource_id, details)."""
    return rows.select(F.lit(action).alias("action"), F.lit(kind).alias("resource_type"), F.col("resource_id")
        .cast("string").alias("resource_id"), F.lit(user).alias("user_id"), "details", F.lit(now).cast("timestamp")
        .alias("at"))


def suppress(space: Workspace, entity: str, kind: str, reason: str, user: str, now: str) -> None:
    """Hide an entity from all public reads, with an audit row; one that was restored is hidden again."""
    spark, t = space.spark, F.lit(now).cast("timestamp")
    row = spark.range(1).select(
        F.lit(entity).alias("entity_id"), F.lit(kind).alias("entity_type"), F.lit(reason).alias("reason"), F.lit(user).alias("created_by"), t.alias(
            "created_at"), F.lit(None).cast("string").alias("restored_by"), F.lit(None).cast("timestamp").alias("restored_at")
    )
    space.upsert("suppressions", row, ["entity_id"])
    note = spark.range(1).select(F.lit(entity).alias("resource_id"), F.to_json(F.struct(F.lit(kind).alias("entity_type"), F.lit(reason)
        .alias("reason"))).alias("details"))
    space.append("audit", audited("suppress_public_entity", "public_entity_suppression", user, now, note))


def restore(space: Workspace, entity: str, user: str, now: str) -> None:
    """Show a hidden entity again, with an audit row; raises LookupError where it isn't hidden."""
    rows = space.read("suppressions")
    hit = (F.col("entity_id") == entity) & F.col("restored_at").isNull()
    if rows.where(hit).isEmpty():
        raise LookupError(f"{entity} is not hidden")
    t = F.lit(now).cast("timestamp")
    space.replace("suppressions", rows.withColumns({"restored_by": F.when(hit, F.lit(user)).otherwise(F.col("restored_by")), "restored_at": F.when(
        hit, t).otherwise(F.col("restored_at"))}))
    note = space.spark.range(1).select(F.lit(entity).alias("resource_id"), F.lit("{}").alias("details"))
    space.append("audit", audited("restore_public_entity", "public_entity_suppression", user, now, note))
