"""Legs, lengths and lines of numbered routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stopwise.functions.geo import haversine_km

# Consecutive stops that one task may hold of a route.
SEGMENT_STOPS = 10_000


def _segments(stops: DataFrame, size: int, overlap: int) -> DataFrame:
    """Cut routes into segments of ``size`` visits. ``overlap`` 1 repeats a segment's last stop in the next."""
    segment = F.floor((F.col("visit_seq") - 1) / size).cast("int")
    last_in_segment = F.col("visit_seq") % size == 0
    segments = F.when(last_in_segment, F.array(segment, segment + overlap)).otherwise(F.array(segment))
    return stops.withColumn("part", F.explode(segments))


def route_legs(stops: DataFrame, keys: list[str], depot: tuple[float, float], size: int = SEGMENT_STOPS) -> DataFrame:
    """Add to each stop the location before it (the depot for the first) and the leg from there.

    Visit numbers are dense, so the stop before is found within segments of a route and no task has
    to hold a whole route.
    """
    window = Window.partitionBy(*keys, "part").orderBy("visit_seq")
    first = F.col("visit_seq") == 1
    return (
        _segments(stops, size, 1)
        .withColumns(
            {
                "prev_lat": F.when(first, F.lit(depot[0])).otherwise(F.lag("lat").over(window)),
                "prev_lon": F.when(first, F.lit(depot[1])).otherwise(F.lag("lon").over(window)),
            }
        )
        .where(F.col("part") == F.floor((F.col("visit_seq") - 1) / size))
        .drop("part")
        .withColumn("leg_km", haversine_km(F.col("prev_lat"), F.col("prev_lon"), F.col("lat"), F.col("lon")))
    )


def route_lengths(legs: DataFrame, keys: list[str]) -> DataFrame:
    return legs.groupBy(*keys).agg(F.count(F.lit(1)).alias("stops"), F.sum("leg_km").alias("length_km"))


def route_path(stops: DataFrame, keys: list[str], depot: tuple[float, float], size: int = SEGMENT_STOPS) -> DataFrame:
    """Line of each route from the depot through its stops, without the way back.

    One array per route, or several parts that each begin where the one before ends if the route is
    longer than ``size`` stops.
    """
    point = F.struct("visit_seq", "lat", "lon")
    start = F.array(
        F.struct(F.lit(0).alias("visit_seq"), F.lit(depot[0]).alias("lat"), F.lit(depot[1]).alias("lon"))
    )
    parts = (
        _segments(stops, size, 1)
        .groupBy(*keys, "part")
        .agg(F.array_sort(F.collect_list(point)).alias("path"))
        # The last stop of a route may close a full segment; nothing follows it.
        .where((F.size("path") > 1) | (F.element_at("path", 1)["visit_seq"] % size != 0) | (F.col("part") == 0))
    )
    return parts.withColumn("path", F.when(F.col("part") == 0, F.concat(start, "path")).otherwise(F.col("path")))
