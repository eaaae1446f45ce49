"""The life of crawl requests and attempts as transitions of tables: claim, renew, expire, finish, retry, requeue.

requests: id, priority, next_due_at, enabled, cohort (active or backlog), last_completed_at.
attempts: request_id, number (from 0 in each generation of retries), state, worker,
started_at, lease_expires_at, finished_at. A step takes tables and a time and returns
tables; who applies it holds the tables and applies one step at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithgraph.functions.columns import retry_delay

#: Attempts of a generation of retries, minutes of a lease, and days until a completed request is due again.
ATTEMPTS, LEASE_MINUTES, FRESH_DAYS = 5, 10, 7
#: Starts of backlog requests within a trailing window. Fixed values.
BACKLOG_STARTS, BACKLOG_MINUTES = 10, 60
#: What an attempt can end as. Fixed values.
COMPLETE, PARTIAL, RETRYABLE, PERMANENT, CANCELLED = "complete", "partial", "retryable_failure", "permanent_failure", "cancelled"


def _time(now: str) -> Column:
    return F.lit(now).cast("timestamp")


def expired(attempts: DataFrame, now: str) -> DataFrame:
    """Attempts whose lease has run out end as failures that may be retried."""
    over = (F.col("state") == "leased") & (F.col("lease_expires_at") < _time(now))
    return attempts.withColumns({"finished_at": F.when(over, _time(now)).otherwise(F.col("finished_at")), "state": F.when(over, RETRYABLE)
        .otherwise(F.col("state"))})


def due(requests: DataFrame, attempts: DataFrame, now: str, starts: int = BACKLOG_STARTS, minutes: int = BACKLOG_MINUTES, most: int = ATTEMPTS) -> DataFrame:
    """id, priority, next_due_at and number of the requests that may be claimed, first ones first.

    Enabled, due, without a live lease, with attempts left in this generation (failures since
    the last completion), and for the backlog only while few of it were started lately.
    """
    live = attempts.where((F.col("state") == "leased") & (F.col("lease_expires_at") >= _time(now))).select(F.col("request_id").alias("id"))
    ready = requests.where(F.col("enabled") & (F.col("next_due_at") <= _time(now))).join(live, "id", "left_anti")
    failed = attempts.where(F.col("state") == RETRYABLE).select(F.col("request_id").alias("id"), "number", "started_at")
    kept = failed.join(requests.select("id", "last_completed_at"), "id").where(F.col("last_completed_at")
        .isNull() | (F.col("started_at") >= F.col("last_completed_at")))
    next_ = kept.groupBy("id").agg((F.max("number") + 1).alias("number"))
    recent = attempts.where(F.col("started_at") >= _time(now) - F.make_dt_interval(mins=F.lit(minutes))).select(F.col("request_id").alias("id"))
    backlog = recent.join(requests.where("cohort = 'backlog'").select("id"), "id", "left_semi").agg((F.count("*") < starts).alias("_open"))
    found = ready.join(next_, "id", "left").withColumn("number", F.coalesce("number", F.lit(0))).where(F.col("number") < most)
    found = found.crossJoin(F.broadcast(backlog)).where((F.col("cohort") == "active") | F.col("_open"))  # one row
    return found.select("id", "priority", "next_due_at", "number").orderBy(F.desc("priority"), "next_due_at", "id")


def claimed(requests: DataFrame, attempts: DataFrame, worker: str, now: str, lease: int = LEASE_MINUTES) -> tuple[DataFrame, DataFrame]:
    """The attempt that a worker starts (no row where nothing is due), and all attempts with it."""
    known = expired(attempts, now)
    one = due(requests, known, now).limit(1)
    end = _time(now) + F.make_dt_interval(mins=F.lit(lease))
    new = one.select(
        F.col("id").alias("request_id"), "number", F.lit("leased").alias("state"), F.lit(worker).alias("worker"), _time(now).alias(
            "started_at"), end.alias("lease_expires_at"), F.lit(None).cast("timestamp").alias("finished_at")
    )
    return new, known.unionByName(new)


def renewed(attempts: DataFrame, request: int, worker: str, now: str, lease: int = LEASE_MINUTES) -> DataFrame:
    """Attempts after a heartbeat; a worker that no longer owns the lease changes nothing."""
    own = (F.col("request_id") == request) & (F.col("worker") == worker) & (F.col("state") == "leased") & (F.col("lease_expires_at") >= _time(now))
    return attempts.withColumn("lease_expires_at", F.when(own, _time(now) + F.make_dt_interval(mins=F.lit(lease)))
        .otherwise(F.col("lease_expires_at")))


def finished(requests: DataFrame, attempts: DataFrame, outcomes: DataFrame, now: str, most: int = ATTEMPTS, fresh: int = FRESH_DAYS) -> tuple[
    DataFrame, DataFrame]:
    """Requests and attempts after outcomes (request_id, worker, outcome) of owned leases.

    The last failure that may be retried becomes a permanent one; others are due again after
    a growing wait, everything else after the freshness time.
    """
    told = outcomes.select("request_id", "worker", "outcome")
    j = attempts.join(told, ["request_id", "worker"], "left")
    ended = F.col("outcome").isNotNull() & (F.col("state") == "leased")
    outcome = F.when((F.col("outcome") == RETRYABLE) & (F.col("number") >= most - 1), PERMANENT).otherwise(F.col("outcome"))
    j = j.withColumns({"_ended": ended, "state": F.when(ended, outcome).otherwise(F.col("state")), "finished_at": F.when(ended, _time(now))
        .otherwise(F.col("finished_at"))})
    wait = F.when(F.col("state") == RETRYABLE, retry_delay(F.col("number").cast("double"), F.col("request_id"), F.col("number")) * 60).otherwise(
        F.lit(fresh * 86400.0))
    last = j.where("_ended").select(F.col("request_id").alias("id"), F.col("state").alias("_state"), wait.alias("_wait"))
    r = requests.join(last, "id", "left")
    due_at = F.when(F.col("_wait").isNotNull(), F.timestamp_seconds(F.unix_timestamp(_time(now)) + F.col("_wait"))).otherwise(F.col("next_due_at"))
    done = F.when(F.col("_state").isin(COMPLETE, PARTIAL), _time(now)).otherwise(F.col("last_completed_at"))
    return r.withColumns({"next_due_at": due_at, "last_completed_at": done}).select(*requests.columns), j.select(*attempts.columns)


def requeued(jobs: DataFrame, now: str) -> DataFrame:
    """Jobs (status, retry_count, max_retries, next_retry_at, visible_at) with the failed ones back in the queue whose time has come."""
    back = (F.col("status") == "failed") & F.coalesce(F.col("next_retry_at") <= _time(now), F.lit(False)) & (F.col("retry_count") < F.col(
        "max_retries"))
    return jobs.withColumns({"visible_at": F.when(back, _time(now)).otherwise(F.col("visible_at")), "status": F.when(back, "queued")
        .otherwise(F.col("status"))})


def reset(jobs: DataFrame, now: str, minutes: int) -> DataFrame:
    """Jobs with those queued again that have been running for too long."""
    stuck = (F.col("status") == "crawling") & (F.col("last_attempt") < _time(now) - F.make_dt_interval(mins=F.lit(minutes)))
    return jobs.withColumn("status", F.when(F.coalesce(stuck, F.lit(False)), "queued").otherwise(F.col("status")))
