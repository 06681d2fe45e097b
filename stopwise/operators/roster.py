"""Suggested drivers by route and customer networks: two optional enrichments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopwise.constants import NO_ROSTER_DRIVER
from stopwise.functions.text import clean_route, key_text, strip
from stopwise.operators.storage import BROADCAST_BYTES, Scratch, measured_bytes


def roster_lookup(roster: DataFrame) -> DataFrame:
    """One driver per route: the one on the last line that names the route."""
    return (
        roster.select(strip(F.col("route")).alias("route"), strip(F.col("driver_name")).alias("driver_name"), "row_no")
        .where(F.col("route").isNotNull())
        .groupBy("route")
        .agg(F.max_by("driver_name", "row_no").alias("driver_name"))
    )


def assign_roster(df: DataFrame, roster: DataFrame | None, fallback: str = NO_ROSTER_DRIVER) -> DataFrame:
    """Add ``driver_name`` from the roster by the route in ``area_desc``; without a roster, the fallback."""
    if roster is None:
        return df.withColumn("driver_name", F.lit(fallback))
    routed = df.withColumn("route", clean_route(F.col("area_desc")))
    return (
        routed.join(roster_lookup(roster), "route", "left")
        .withColumn("driver_name", F.coalesce("driver_name", F.lit(fallback)))
        .drop("route")
    )


def enrich_networks(df: DataFrame, networks: DataFrame | None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Add ``network`` and ``subnetwork`` by customer; several networks give several rows.

    ``customer_id`` becomes text on the way, as the file holds it as text, with or without networks.
    Networks of up to ``limit`` bytes are broadcast; for more, the customers are written once.
    """
    left = df.withColumn("customer_id", key_text(F.col("customer_id")))
    if networks is None:
        return left.withColumns({"network": F.lit(""), "subnetwork": F.lit("")})
    right = networks.select(
        key_text(F.col("customer_id")).alias("customer_id"),
        F.coalesce(strip(F.col("network")), F.lit("")).alias("network"),
        F.coalesce(strip(F.col("subnetwork")), F.lit("")).alias("subnetwork"),
    ).where(F.col("customer_id").isNotNull())
    if measured_bytes(right) <= limit:
        joined = left.join(F.broadcast(right), "customer_id", "left").fillna("", ["network", "subnetwork"])
    else:
        # A left join cannot split a key that is hot on its right side; an inner join can.
        left = Scratch(df.sparkSession, "networks").save(left, "customers")
        matched = left.join(right, "customer_id")
        single = left.join(right.select("customer_id").distinct(), "customer_id", "left_anti")
        joined = matched.unionByName(single.withColumns({"network": F.lit(""), "subnetwork": F.lit("")}))
    return joined
