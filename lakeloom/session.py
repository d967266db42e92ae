"""Spark sessions with the settings that query results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: ANSI errors, UTC and zone-less timestamps, adaptive plans with skew handling.
SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(master: str | None = None, shuffle_partitions: int | None = None, **more: str) -> SparkSession:
    """A session; ``master`` and the number of shuffle partitions are left to the cluster unless given."""
    builder = SparkSession.builder.appName("lakeloom")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.config(map=SETTINGS | more).getOrCreate()
