"""Session settings the jobs are meant to run with."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(master: str | None = None, **settings: str) -> SparkSession:
    """Session with a fixed time zone and adaptive execution; ``settings`` add to or replace ours.

    On a cluster leave ``spark.sql.shuffle.partitions`` high: adaptive execution merges small
    partitions and splits skewed joins, but it cannot split what was never divided.
    """
    ours = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    builder = SparkSession.builder.appName("stopwise")
    if master:
        builder = builder.master(master)
    for key, value in {**ours, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
