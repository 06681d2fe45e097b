"""Delivery groups and the earliest group of each customer."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def delivery_groups(
    deliveries: DataFrame, ops, statuses, first: date, last: date, keys: list[str], dates: Column | None = None
) -> DataFrame:
    """Weight and revenue per group of deliveries that leave between two days, both included.

    The sums depend on the departure but not on the day the report is for, so they are made once,
    before any delivery is multiplied over report days. Spark combines them before the shuffle, and
    the shuffle is by the whole group key, which a single busy customer or driver cannot overload.
    Decimal amounts are summed as decimals.
    """
    leaves = F.col("departure_ts")
    wanted = deliveries.where(
        F.col("op_code").isin(*ops)
        & F.col("status").isin(*statuses)
        & (leaves >= F.lit(first).cast("timestamp_ntz"))
        & (leaves < F.lit(last + timedelta(days=1)).cast("timestamp_ntz"))
    )
    if "departure_date" in deliveries.columns:
        wanted = wanted.where(F.col("departure_date").between(F.lit(first), F.lit(last))).drop("departure_date")
    if dates is not None:
        wanted = wanted.where(dates)
    return (
        wanted.groupBy(*keys)
        .agg(
            F.sum(F.coalesce("weight_kg", F.lit(0))).alias("weight_kg"),
            F.sum(F.coalesce("revenue", F.lit(0))).alias("revenue"),
        )
        .withColumn("departure_date", F.col("departure_ts").cast("date"))
    )


def earliest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row of each ``keys`` group.

    Spark turns ``row_number() = 1`` into a group limit that already drops the other rows of a group
    in every task before the shuffle, so a hot group reaches the last task as one row per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")


def first_in_window(daily: DataFrame, days: int, first: date, last: date) -> DataFrame:
    """Report days for which a customer's day is the first one in ``[as_of, as_of + days]``.

    ``daily`` holds one row per customer and departure date. A date comes first exactly for the
    report days after the customer's previous date and not more than ``days`` before it. Reports are
    thus assigned by looking back one row, without multiplying deliveries by the window length and
    ranking them again; a customer has at most one row per calendar day here.
    """
    before = F.lag("departure_date").over(Window.partitionBy("customer_id").orderBy("departure_date"))
    opens = F.greatest(
        F.date_sub("departure_date", days), F.coalesce(F.date_add(before, 1), F.lit(first)), F.lit(first)
    )
    closes = F.least(F.col("departure_date"), F.lit(last))
    return daily.withColumns({"_opens": opens, "_closes": closes}).where("_opens <= _closes")
