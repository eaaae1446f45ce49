"""Names of queries, what they run, and SQL for another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kithgraph.plans.oracle import with_tables
from kithgraph.sources.corpus import Corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Corpus], DataFrame]], Callable[[Corpus], DataFrame]]:
    """Register a query over a corpus, with its SQL if there is any."""

    def keep(f: Callable[[Corpus], DataFrame]) -> Callable[[Corpus], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: f(Corpus(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = with_tables(sql)
        return f

    return keep


def add(name: str, f: Callable[[Corpus], DataFrame], sql: str | None = None) -> None:
    query(name, sql)(f)
