"""The five delivery scenarios: which deliveries a report holds, one row per customer and report day."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopwise.constants import (
    ACTIVE,
    CAPITAL_OPS,
    CITY_DEPOT,
    DEFAULT_PRIORITY,
    INTERIOR_DEPOT,
    INTERIOR_GENERAL_OPS,
    INTERIOR_WEEK_OPS,
    ROUTED_STATUSES,
)
from stopwise.functions.dates import reference_date, week_mon_tue, week_start
from stopwise.functions.text import priority, to_number
from stopwise.operators.calendar import Calendar
from stopwise.operators.earliest import delivery_groups, earliest, first_in_window
from stopwise.operators.roster import assign_roster


@dataclass(frozen=True)
class Scenario:
    """What sets one scenario apart from the others."""

    name: str
    ops: Sequence[int]
    depot: tuple[float, float]
    normal_days: int | None = None  # a single reference date, this many days ahead (two on Saturdays)
    window_days: int | None = None  # every date from the report day to this many days ahead
    with_driver: bool = True  # deliveries need a driver, whose name belongs to the group
    with_area: bool = False  # of a window: the customer's area is shown and gives the driver through the roster
    with_priority: bool = True  # the status and the customer's priorities are part of the report
    route_key: str = "driver_name"


SCENARIOS = {
    s.name: s
    for s in (
        Scenario("next_day_by_driver", CAPITAL_OPS, CITY_DEPOT, normal_days=1),
        Scenario(
            "six_day_by_date", CAPITAL_OPS, CITY_DEPOT, window_days=5, with_driver=False, route_key="departure_ts"
        ),
        Scenario("same_day_by_driver", CAPITAL_OPS, CITY_DEPOT, normal_days=0),
        Scenario("interior_mon_tue", INTERIOR_WEEK_OPS, INTERIOR_DEPOT, with_priority=False),
        Scenario(
            "interior_eight_day_by_roster",
            INTERIOR_GENERAL_OPS,
            INTERIOR_DEPOT,
            window_days=7,
            with_driver=False,
            with_area=True,
        ),
    )
}


def find_scenario(name: str) -> Scenario:
    if name not in SCENARIOS:
        raise ValueError(f"unknown scenario {name!r}, expected one of {', '.join(SCENARIOS)}")
    return SCENARIOS[name]


def route_keys(name: str) -> list[str]:
    return ["as_of", find_scenario(name).route_key]


def active(customers: DataFrame) -> DataFrame:
    return customers.where(F.col("status") == ACTIVE)


def scenario(
    name: str,
    deliveries: DataFrame,
    customers: DataFrame,
    drivers: DataFrame | None = None,
    areas: DataFrame | None = None,
    *,
    calendar: Calendar,
    roster: DataFrame | None = None,
    ops: Sequence[int] | None = None,
    statuses: Sequence[int] = ROUTED_STATUSES,
    ordered: bool = False,
) -> DataFrame:
    """Report rows of a scenario for every day of the calendar.

    Per customer and report day only the earliest delivery group is kept, with its weight and
    revenue. Customer, driver and area keys are taken as unique in their tables.
    """
    spec = find_scenario(name)
    ops = spec.ops if ops is None else ops
    group = ["customer_id", "departure_ts", "op_code"]
    group += ["status"] if spec.with_priority else []
    ties = ["departure_ts", "op_code"] + group[3:]
    if not calendar.gapless:
        # Dates between the days that no report day looks at are left out before anything is summed. They
        # are at most as many as a calendar has, so they are broadcast, and a table that is partitioned by
        # the date reads their partitions only.
        leaves = F.col("departure_date" if "departure_date" in deliveries.columns else "departure_ts").cast("date")
        dates = F.broadcast(_dates_of(calendar, spec))
        deliveries = deliveries.join(dates, leaves == F.col("_wanted"), "left_semi")
    if spec.with_driver:
        deliveries = deliveries.join(drivers.select("driver_id", "driver_name"), "driver_id")
        group += ["driver_name"]
        ties += ["driver_name"]

    people = _report_customers(customers, spec)
    if spec.window_days is not None:
        last = calendar.last + timedelta(days=spec.window_days)
        groups = delivery_groups(deliveries, ops, statuses, calendar.first, last, group)
        daily = earliest(groups, ["customer_id", "departure_date"], ties)
        placed = first_in_window(daily, spec.window_days, calendar.first, calendar.last)
        rows = placed.join(people, "customer_id")
        if spec.with_area:
            rows = assign_roster(rows.join(areas.select("area_id", "area_desc"), "area_id", "left"), roster)
        # Rows are multiplied over the report days last, when nothing is left to be computed per row.
        ahead = F.explode(F.sequence(F.lit(0), F.date_diff("_closes", "_opens")))
        rows = rows.withColumn("_ahead", ahead).withColumn("as_of", F.date_add("_opens", F.col("_ahead")))
        if not calendar.gapless:
            rows = rows.join(calendar.days, "as_of")
    elif spec.normal_days is not None:
        dates = calendar.days.withColumn("departure_date", reference_date(F.col("as_of"), spec.normal_days))
        first, last = calendar.first + timedelta(days=spec.normal_days), calendar.last + timedelta(days=2)
        groups = delivery_groups(deliveries, ops, statuses, first, last, group)
        daily = earliest(groups, ["customer_id", "departure_date"], ties)
        rows = daily.join(dates, "departure_date").join(people, "customer_id")
    else:
        # Monday and Tuesday are the same for all days of a Sunday-started week, so the first of them on
        # which a customer has deliveries is found once per week and then given to the week's days.
        weeks = calendar.days.withColumn("week", week_start(F.col("as_of")))
        # From the Monday before a Saturday to the Tuesday after a Sunday.
        first, last = calendar.first - timedelta(days=5), calendar.last + timedelta(days=2)
        leaves = F.col("departure_ts").cast("date")
        mon_tue = F.array_contains(week_mon_tue(leaves), leaves)
        groups = delivery_groups(deliveries, ops, statuses, first, last, group, mon_tue)
        weekly = earliest(groups.withColumn("week", week_start(leaves)), ["customer_id", "week"], ties)
        rows = weekly.join(weeks, "week").join(people, "customer_id")

    columns = ["as_of", "departure_ts", "customer_id", "op_code", "trade_name", "lat", "lon"]
    columns += ["area_desc"] if spec.with_area else []
    columns += ["driver_name"] if spec.with_driver or spec.with_area else []
    columns += ["priority"]
    columns += ["saturday_priority"] if "saturday_priority" in rows.columns else []
    report = rows.select(*columns, "weight_kg", "revenue")
    return report.orderBy("as_of", "departure_ts", "customer_id") if ordered else report


def _dates_of(calendar: Calendar, spec: Scenario) -> DataFrame:
    """Departure dates that the report days look at.

    The filter, which all days pass, tells Spark that it is worth while to prune partitions by them.
    """
    day = F.col("as_of")
    if spec.window_days is not None:
        dates = F.explode(F.sequence(day, F.date_add(day, spec.window_days), F.expr("interval 1 day")))
    elif spec.normal_days is not None:
        dates = reference_date(day, spec.normal_days)
    else:
        dates = F.explode(week_mon_tue(day))
    days = calendar.days.where(day.between(F.lit(calendar.first), F.lit(calendar.last)))
    return days.select(dates.alias("_wanted")).distinct()


def _report_customers(customers: DataFrame, spec: Scenario) -> DataFrame:
    columns = [
        F.col("customer_id"),
        F.col("trade_name"),
        to_number(F.col("lat_raw")).alias("lat"),
        to_number(F.col("lon_raw")).alias("lon"),
    ]
    if spec.with_priority:
        columns.append(priority(F.col("priority_raw")).alias("priority"))
        if "saturday_priority" in customers.columns:
            columns.append(F.col("saturday_priority"))
    else:
        columns.append(F.lit(DEFAULT_PRIORITY).alias("priority"))
    if spec.with_area:
        columns.append(F.col("area_id"))
    return active(customers).select(*columns)
