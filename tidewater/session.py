"""A session with the settings that the library's results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.ui.enabled": "false",
}


def session(master: str | None = None, more: dict[str, str] | None = None) -> SparkSession:
    """The session; ``master`` is left to the cluster when it is None."""
    builder = SparkSession.builder.appName("tidewater").config(map=SETTINGS | (more or {}))
    if master:
        builder = builder.master(master)
    found = builder.getOrCreate()
    found.sparkContext.setLogLevel("ERROR")
    return found
