"""Sessions with the settings that the library's plans count on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "kithgraph", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew handling, and Arrow for the few pandas kernels."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    builder = SparkSession.builder.appName(name)
    return (builder.master(master) if master else builder).config(map=settings).getOrCreate()
