"""Totals, palettes, boxes and legends of a scenario report, per report day."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopwise.constants import DEFAULT_PRIORITY, MISSING_TEXT, UNKNOWN_DRIVER
from stopwise.functions.colors import cyclic_color
from stopwise.functions.dates import reference_date
from stopwise.functions.display import format_currency, format_date, format_weight, priority_label
from stopwise.functions.text import text_or_empty
from stopwise.operators.numbering import number_within
from stopwise.operators.routes import ensure_column, placeable
from stopwise.operators.storage import TASK_ROWS, Scratch
from stopwise.plans.scenarios import find_scenario

DAY = ["as_of"]


def report_totals(report: DataFrame) -> DataFrame:
    """Customers and revenue per report day, with customers that have no place on the map.

    A report has one row per customer and day, so its rows are counted.
    """
    return report.groupBy(*DAY).agg(F.count("customer_id").alias("customers"), F.sum("revenue").alias("revenue"))


def driver_totals(report: DataFrame) -> DataFrame:
    """Revenue per driver and report day; rows without a driver belong to nobody."""
    named = ensure_column(report, "driver_name", UNKNOWN_DRIVER).where(F.col("driver_name").isNotNull())
    return named.groupBy(*DAY, "driver_name").agg(F.sum("revenue").alias("revenue"))


def _largest_day(entries: DataFrame) -> int:
    return entries.groupBy(*DAY).count().agg(F.max("count")).first()[0] or 0


def _palette(distinct: DataFrame, order: list[Column], rows_per_day: int | None) -> DataFrame:
    """Positions and colours; without a proved bound the entries are written and those of each day counted."""
    if rows_per_day is None:
        distinct = Scratch(distinct.sparkSession, "palette").save(distinct, "entries")
        rows_per_day = _largest_day(distinct)
    numbered = number_within(distinct, DAY, order, "_number", rows_per_day)
    position = (F.col("_number") - 1).alias("position")
    return numbered.select("*", position, cyclic_color(F.col("_number") - 1).alias("color")).drop("_number")


def route_palette(report: DataFrame, rows_per_day: int | None = None) -> DataFrame:
    """Colour of each driver, given in the order in which drivers first leave."""
    named = ensure_column(report, "driver_name", UNKNOWN_DRIVER).where(F.col("driver_name").isNotNull())
    drivers = named.groupBy(*DAY, "driver_name").agg(F.min("departure_ts").alias("first_departure"))
    return _palette(drivers, [F.col("first_departure"), F.col("driver_name")], rows_per_day)


def date_palette(report: DataFrame, rows_per_day: int | None = None) -> DataFrame:
    """Colour of each departure time, given in time order."""
    times = report.where(F.col("departure_ts").isNotNull()).select(*DAY, "departure_ts").distinct()
    return _palette(times, [F.col("departure_ts")], rows_per_day)


def bounding_box(report: DataFrame, depot: tuple[float, float]) -> DataFrame:
    """Box around the depot and all placed customers; a day without any has no box."""
    lat, lon = F.lit(depot[0]), F.lit(depot[1])
    return (
        placeable(report)
        .groupBy(*DAY)
        .agg(
            F.least(F.min("lat"), lat).alias("min_lat"),
            F.least(F.min("lon"), lon).alias("min_lon"),
            F.greatest(F.max("lat"), lat).alias("max_lat"),
            F.greatest(F.max("lon"), lon).alias("max_lon"),
        )
    )


def legend_date(name: str, as_of: Column) -> Column:
    """Departure date that a scenario's legend shows; null where it shows none."""
    spec = find_scenario(name)
    if spec.normal_days is not None:
        return reference_date(as_of, spec.normal_days)
    if spec.route_key == "departure_ts":
        return as_of
    return F.lit(None).cast("date")


def legend(report: DataFrame, name: str, rows_per_day: int | None = None, limit: int = TASK_ROWS) -> DataFrame:
    """One row per driver (or departure time) of a report day, with its colour and the day's totals.

    A report has each customer once per day, so the day's totals are sums over the entries and the
    report is read once. Rows without a driver count in the totals and are no entry. Without a proved
    bound ``rows_per_day`` the entries are written and those of each day counted.
    """
    key = find_scenario(name).route_key
    by_time = key == "departure_ts"
    report = report if by_time else ensure_column(report, key, UNKNOWN_DRIVER)
    entries = report.groupBy(*DAY, F.col(key).alias("key")).agg(
        F.min("departure_ts").alias("first_departure"),
        F.count(F.lit(1)).alias("rows"),
        F.sum("revenue").alias("entry_revenue"),
    )
    totals = {
        "total_customers": F.sum("rows"),
        "total_revenue": F.sum("entry_revenue"),
        "_named": F.count("key"),
    }
    if rows_per_day is None:
        entries = Scratch(report.sparkSession, "legend").save(entries, "entries")
        rows_per_day = _largest_day(entries)
    if rows_per_day <= limit:
        day = Window.partitionBy(*DAY)
        entries = entries.withColumns({c: total.over(day) for c, total in totals.items()})
    else:
        days = entries.groupBy(*[F.col(c).alias(f"_of_{c}") for c in DAY]).agg(*[t.alias(c) for c, t in totals.items()])
        same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in DAY])
        entries = entries.join(days, same).drop(*[f"_of_{c}" for c in DAY])
    order = [F.col("key").isNull(), F.col("first_departure"), F.col("key")]
    numbered = number_within(entries, DAY, order, "_number", rows_per_day, limit)
    is_entry = F.col("key").isNotNull()
    # A day on which nobody is named keeps one row for its totals.
    kept = numbered.where(is_entry | (F.col("_named") == 0))
    position = F.when(is_entry, F.col("_number") - 1)
    revenue = F.lit(None).cast("double") if by_time else F.when(is_entry, F.col("entry_revenue"))
    return kept.select(
        *DAY,
        "total_customers",
        "total_revenue",
        format_currency(F.col("total_revenue")).alias("total_text"),
        format_date(legend_date(name, F.col("as_of"))).alias("legend_date"),
        position.alias("position"),
        (F.when(is_entry, format_date(F.col("key"))) if by_time else F.upper("key")).alias("entry"),
        F.when(is_entry, cyclic_color(position)).alias("color"),
        revenue.alias("entry_revenue"),
        F.when(revenue.isNotNull(), format_currency(revenue)).alias("entry_text"),
    )


def stop_details(stops: DataFrame) -> DataFrame:
    """Texts shown for a stop, with defaults where a value or a whole column is missing."""
    for name, default in (
        ("op_code", MISSING_TEXT),
        ("driver_name", MISSING_TEXT),
        ("area_desc", MISSING_TEXT),
        ("priority", DEFAULT_PRIORITY),
        ("weight_kg", 0.0),
        ("revenue", 0.0),
    ):
        stops = ensure_column(stops, name, default)
    stops = ensure_column(stops, "departure_ts", None)
    context = [c for c in ("as_of", "visit_seq") if c in stops.columns]
    return stops.select(
        *context,
        "customer_id",
        text_or_empty(F.col("trade_name")).alias("customer_text"),
        text_or_empty(F.col("op_code")).alias("op_text"),
        text_or_empty(F.col("driver_name")).alias("driver_text"),
        priority_label(F.coalesce("priority", F.lit(DEFAULT_PRIORITY))).alias("priority_text"),
        format_weight(F.col("weight_kg")).alias("weight_text"),
        format_currency(F.col("revenue")).alias("revenue_text"),
        format_date(F.col("departure_ts")).alias("departure_text"),
        text_or_empty(F.col("area_desc")).alias("route_text"),
    )
