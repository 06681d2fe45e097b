"""The days for which reports are made: many in one job rather than one job per day."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Calendar:
    """Distinct ``as_of`` days, with their range known when the plan is made.

    The range becomes a literal filter on the departure time, so Parquet row groups and partitions
    outside it are not read. ``gapless`` tells that every day of the range is present.
    """

    days: DataFrame
    first: date
    last: date
    gapless: bool

    @staticmethod
    def span(spark: SparkSession, first: date, last: date) -> Calendar:
        days = spark.range((last - first).days + 1).select(
            F.date_add(F.lit(first), F.col("id").cast("int")).alias("as_of")
        )
        return Calendar(days, first, last, True)

    @staticmethod
    def of(spark: SparkSession, *days: date) -> Calendar:
        chosen = sorted(set(days))
        frame = spark.createDataFrame([(d,) for d in chosen], "as_of date")
        return Calendar(frame, chosen[0], chosen[-1], chosen[-1] - chosen[0] == timedelta(len(chosen) - 1))

    @staticmethod
    def from_frame(df: DataFrame) -> Calendar | None:
        """Calendar of a DataFrame of days; one small job reads its range. None if it is empty."""
        distinct = df.select("as_of").where("as_of is not null").distinct()
        first, last, count = distinct.agg(F.min("as_of"), F.max("as_of"), F.count(F.lit(1))).first()
        if count == 0:
            return None
        return Calendar(distinct, first, last, (last - first).days + 1 == count)
