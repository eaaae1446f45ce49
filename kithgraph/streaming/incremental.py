"""Incremental refresh of activity and overlap, in batches and as a stream of changed users."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kithgraph.operators.relational import activity, overlap_pairs

#: Part of changed users above which all is built anew.
REBUILD_PART = 0.2


def pair_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """u, v and the change of overlap between two activity sets of the same users, without zeros."""
    signed = overlap_pairs(after).unionByName(overlap_pairs(before).withColumn("overlap_count", -F.col("overlap_count")))
    return signed.groupBy("u", "v").agg(F.sum("overlap_count").alias("delta")).where("delta <> 0")


def refreshed(active: DataFrame, pairs: DataFrame, posts: DataFrame, comments: DataFrame, dirty: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Activity and overlap pairs after what the dirty users (user_id) wrote has changed; equal to a rebuild.

    Only rows of dirty users are aggregated and joined again.
    """
    d = dirty.select("user_id").where("user_id is not null").distinct()
    a = d.withColumnRenamed("user_id", "author_id")
    old = active.join(d, "user_id", "left_semi")
    new = activity(posts.join(a, "author_id", "left_semi"), comments.join(a, "author_id", "left_semi"))
    delta = pair_delta(old, new)
    now = pairs.select("u", "v", "overlap_count").unionByName(delta.select("u", "v", F.col("delta").alias("overlap_count")))
    return active.join(d, "user_id", "left_anti").unionByName(new), now.groupBy("u", "v").agg(F.sum("overlap_count")
        .alias("overlap_count")).where("overlap_count > 0")


def mode(users: int, dirty: DataFrame, known: bool, forced: bool = False) -> str:
    """full or incremental; a null user in the log asks for a rebuild."""
    if forced or not known:
        return "full"
    n, marks = dirty.agg(F.count_distinct("user_id"), F.count_if(F.col("user_id").isNull())).first()
    return "full" if marks or n > REBUILD_PART * max(users, 1) else "incremental"


def changed_users(spark: SparkSession, path: str, schema: str = "user_id long") -> DataFrame:
    """The log of changed users as a stream of JSON files."""
    return spark.readStream.schema(schema).json(path)


def run_refresh(log: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Apply every batch of the log once; ends when all of it is done."""
    return log.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _timed(events: DataFrame, late: str) -> DataFrame:
    """Event times without a zone are taken as the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def windowed_counts(events: DataFrame, width: str = "5 minutes", step: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Events by sliding window and type, with a bound for late ones where events is a stream."""
    rows = _timed(events, late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width, step), "event_type").agg(F.count("*").alias("n"), F.sum("value")
        .alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def session_counts(events: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events by user and session: stretches without a pause of `gap`."""
    rows = _timed(events, late) if events.isStreaming else events
    by = rows.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return by.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n", "total")


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by window and type."""
    rows = _timed(events, late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value")
        .alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def rate(events: DataFrame, key: str = "event_type", width: str = "5 minutes", step: str = "1 minute") -> DataFrame:
    """Events a second by sliding window and key, with quantiles of their values."""
    w = F.window("ts", width, step).alias("w")
    by = events.groupBy(w, key).agg(F.count("*").alias("n"), *(F.expr(f"percentile_disc({p}) within group (order by value)")
        .alias(f"p{round(100 * p)}") for p in (0.5, 0.95)))
    seconds = F.unix_timestamp("w.end") - F.unix_timestamp("w.start")
    return by.select(F.col("w.start").alias("start"), key, (F.col("n") / seconds).alias("per_second"), "p50", "p95")


def once(events: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """Each event once, of those that repeat within the watermark."""
    return _timed(events, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def started_within(events: DataFrame, now: str, minutes: int, limit: int) -> DataFrame:
    """One row: how many starts lie in the trailing interval, and whether more may start."""
    end = F.lit(now).cast("timestamp")
    recent = events.where((F.col("ts") > end - F.make_dt_interval(mins=F.lit(minutes))) & (F.col("ts") <= end))
    return recent.agg(F.count("*").alias("started")).withColumn("may_start", F.col("started") < limit)


def merged_requests(requests: DataFrame) -> DataFrame:
    """One request for each target: the highest priority and the earliest time."""
    return requests.groupBy("target").agg(F.max("priority").alias("priority"), F.min("due_at").alias("due_at"))


def discoveries(seen: DataFrame, budget: int, promoted: DataFrame | None = None, now: str | None = None) -> DataFrame:
    """Candidates with their summed score, mentions first, as many as the day's budget still allows.

    promoted (target, at) are those already promoted: they are no candidates, and those of
    the day of `now` count against the budget.
    """
    by = seen.groupBy("target").agg(F.sum("score").alias("score"), F.max(F.col("mention").cast("int")).alias("mention"))
    order = [F.desc("mention"), F.desc("score"), F.asc("target")]
    if promoted is None:
        return by.orderBy(*order).limit(budget)
    today = F.col("at") >= F.date_trunc("day", F.lit(now).cast("timestamp"))
    left = promoted.where(today).agg(F.greatest(budget - F.count("*"), F.lit(0)).alias("_left"))
    found = by.join(promoted.select("target"), "target", "left_anti").orderBy(*order).limit(budget)
    # At most `budget` rows are ranked.
    ranked = found.withColumn("_k", F.row_number().over(Window.orderBy(*order))).crossJoin(F.broadcast(left))  # left: one row
    return ranked.where("_k <= _left").select(*by.columns)


def aged(jobs: DataFrame, now: str, per_day: int = 1) -> DataFrame:
    """Priorities that rise with the days waited, 100 at most."""
    days = F.floor((F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("created_at")) / 86400)
    return jobs.withColumn("priority", F.least(F.col("priority") + per_day * days, F.lit(100)).cast("long"))


def dirty_users(old: DataFrame, new: DataFrame) -> DataFrame:
    """user_id of everyone whose rows (id, author_id, community_id) were inserted, deleted, or moved to another author or community.

    One row with a null id where the new version is empty and the old one isn't: all must be built anew.
    """
    key = ["id", "author_id", "community_id"]
    a, b = old.select(*key), new.select(*key)
    both = a.select(*key, F.lit(-1).alias("_d")).unionByName(b.select(*key, F.lit(1).alias("_d")))
    changed = both.groupBy(*key).agg(F.sum("_d").alias("_d")).where("_d <> 0").select(F.col("author_id").alias("user_id"))
    counts = a.agg(F.count("*").alias("_a")).crossJoin(b.agg(F.count("*").alias("_b")))  # one-row frames
    emptied = counts.where("_a > 0 and _b = 0").select(F.lit(None).cast(old.schema["author_id"].dataType).alias("user_id"))
    return changed.where("user_id is not null").distinct().unionByName(emptied)


def periodic(log: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, every: str = "1 hour") -> StreamingQuery:
    """Apply what has come in, again and again, until the query is stopped."""
    return log.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
