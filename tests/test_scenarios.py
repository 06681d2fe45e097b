"""Scenarios against the anchors of the derived tables and on small cases that trap shortcuts."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from stopwise.constants import CITY_DEPOT, MISSING_TEXT, UNKNOWN_DRIVER
from stopwise.operators.calendar import Calendar
from stopwise.operators.routes import ensure_column, route_stops
from stopwise.plans import master as masters
from stopwise.plans import reports
from stopwise.plans.scenarios import SCENARIOS, scenario
from stopwise.schemas import AREAS, CUSTOMERS, DELIVERIES, DRIVERS, SOURCE_COLUMNS
from stopwise.sources.tables import from_source_names
from workload import tables as t
from workload.queries import QUERIES, report

SF = "/root/testdata/sf0.001"

# rows, days, customers, weight, revenue over the whole calendar
ANCHORS = {
    "next_day_by_driver": (373, 346, 124, 37872.0, 89415496.24),
    "six_day_by_date": (2452, 1539, 133, 252726.0, 612086770.96),
    "same_day_by_driver": (377, 354, 124, 38406.0, 91177087.77),
    "interior_mon_tue": (669, 613, 69, 59301.0, 150722485.37),
    "interior_eight_day_by_roster": (3306, 1851, 133, 337817.0, 806219418.72),
}


def summary(df):
    return tuple(
        df.agg(
            F.count(F.lit(1)),
            F.countDistinct("as_of"),
            F.countDistinct("customer_id"),
            F.round(F.sum("weight_kg"), 2),
            F.round(F.sum("revenue"), 2),
        ).first()
    )


@pytest.mark.parametrize("name", SCENARIOS)
def test_anchors(spark, name):
    assert summary(report(name, spark, SF)) == ANCHORS[name]


@pytest.mark.parametrize("name", SCENARIOS)
def test_a_few_days_give_the_same_rows_as_the_whole_calendar(spark, name):
    whole = report(name, spark, SF)
    days = [date(1996, 2, 3), date(1996, 2, 4), date(1998, 7, 14), date(1999, 1, 1), date(2001, 8, 1)]
    few = report(name, spark, SF, Calendar.of(spark, *days))
    expected = whole.where(F.col("as_of").isin(days))
    assert few.exceptAll(expected).isEmpty() and expected.exceptAll(few).isEmpty()


def frames(spark, deliveries, customers=None, drivers=None, areas=None):
    customers = customers or [(c, f"C{c}", f"P{c}", "-3.5", "-38.5", 1, 1, "1", 0, 1, 1, 2) for c in range(1, 6)]
    return (
        spark.createDataFrame(deliveries, DELIVERIES),
        spark.createDataFrame(customers, CUSTOMERS),
        spark.createDataFrame(drivers or [(1, "D1"), (2, "D2"), (3, None)], DRIVERS),
        spark.createDataFrame(areas or [(1, "1 - L81-A"), (2, None)], AREAS),
    )


SAT, SUN, MON, TUE = (datetime(2024, 6, d, 8) for d in (1, 2, 3, 4))


def run(spark, name, deliveries, *days, **kwargs):
    tables = frames(spark, deliveries, **kwargs)
    rows = scenario(name, *tables, calendar=Calendar.of(spark, *days)).collect()
    return sorted(rows, key=lambda r: (r.as_of, r.customer_id))


def test_saturday_looks_at_monday(spark):
    rows = [(1, 1, 38, 1, 1, MON, 5.0, 10.0), (2, 2, 38, 1, 1, SUN, 1.0, 2.0)]
    saturday, sunday = SAT.date(), SUN.date()
    for name in ("same_day_by_driver", "next_day_by_driver"):
        assert [r.customer_id for r in run(spark, name, rows, saturday)] == [1]
    assert [r.customer_id for r in run(spark, "same_day_by_driver", rows, sunday)] == [2]
    assert [r.customer_id for r in run(spark, "next_day_by_driver", rows, sunday)] == [1]


def test_only_the_earliest_group_counts_and_nulls_are_zero(spark):
    later = MON.replace(hour=9)
    rows = [
        (1, 1, 38, 1, 1, MON, 5.0, None),
        (2, 1, 38, 1, 1, MON, None, 7.0),
        (3, 1, 39, 1, 1, MON, 100.0, 100.0),
        (4, 1, 38, 1, 1, later, 100.0, 100.0),
    ]
    (row,) = run(spark, "same_day_by_driver", rows, MON.date())
    assert (row.weight_kg, row.revenue, row.op_code, row.departure_ts) == (5.0, 7.0, 38, MON)


def test_status_splits_groups_except_in_the_week_report(spark):
    capital = [(1, 1, 38, 1, 1, MON, 5.0, 1.0), (2, 1, 38, 3, 1, MON, 6.0, 2.0)]
    assert run(spark, "same_day_by_driver", capital, MON.date())[0].weight_kg == 5.0
    assert run(spark, "six_day_by_date", capital, MON.date())[0].weight_kg == 5.0
    interior = [(i, c, 45, *rest) for i, c, _, *rest in capital]
    (row,) = run(spark, "interior_mon_tue", interior, MON.date())
    assert (row.weight_kg, row.priority) == (11.0, 3)


def test_filters_and_missing_keys(spark):
    rows = [
        (1, 1, 999, 1, 1, MON, 1.0, 1.0),  # operation not routed
        (2, 2, 38, 2, 1, MON, 1.0, 1.0),  # status not routed
        (3, 3, 38, 1, None, MON, 1.0, 1.0),  # no driver
        (4, 4, 38, 1, 9, MON, 1.0, 1.0),  # unknown driver
        (5, 9, 38, 1, 1, MON, 1.0, 1.0),  # unknown customer
        (6, 5, 38, 1, 1, MON, 1.0, 1.0),  # inactive customer
    ]
    customers = [(c, f"C{c}", None, "x", "-38.5", 2 if c == 5 else 1, 1, None, 0, 1, 1, 2) for c in range(1, 6)]
    assert run(spark, "same_day_by_driver", rows, MON.date(), customers=customers) == []
    without_driver = run(spark, "six_day_by_date", rows, MON.date(), customers=customers)
    assert [(r.customer_id, r.lat, r.priority) for r in without_driver] == [(3, None, 3), (4, None, 3)]


def test_windows_are_inclusive_and_start_at_the_report_day(spark):
    rows = [(1, 1, 38, 1, 1, datetime(2024, 6, 3, 23, 59), 1.0, 1.0), (2, 1, 38, 1, 1, datetime(2024, 6, 6, 0), 2.0, 2.0)]
    days = [date(2024, 5, 28), date(2024, 5, 29), date(2024, 6, 3), date(2024, 6, 4), date(2024, 6, 7)]
    found = {r.as_of: r.weight_kg for r in run(spark, "six_day_by_date", rows, *days)}
    assert found == {days[1]: 1.0, days[2]: 1.0, days[3]: 2.0}


def test_week_report_holds_for_the_whole_sunday_week(spark):
    rows = [(1, 1, 45, 1, 1, TUE, 1.0, 1.0), (2, 2, 45, 1, 1, MON, 2.0, 2.0), (3, 2, 45, 1, 1, TUE, 9.0, 9.0)]
    days = [date(2024, 6, d) for d in (1, 2, 8, 9)]
    found = [(r.as_of.day, r.customer_id, r.weight_kg) for r in run(spark, "interior_mon_tue", rows, *days)]
    assert found == [(2, 1, 1.0), (2, 2, 2.0), (8, 1, 1.0), (8, 2, 2.0)]


def test_unknown_scenario(spark):
    with pytest.raises(ValueError, match="unknown scenario"):
        run(spark, "nothing", [], MON.date())


def test_ordered_report(spark):
    tables = frames(spark, [(i, i, 38, 1, 1, MON.replace(hour=20 - i), 1.0, 1.0) for i in range(1, 5)])
    rows = scenario("same_day_by_driver", *tables, calendar=Calendar.of(spark, MON.date()), ordered=True).collect()
    assert [r.customer_id for r in rows] == [4, 3, 2, 1]


def test_a_partitioned_delivery_table_is_pruned_by_date(spark, tmp_path):
    deliveries = t.deliveries(spark, SF).withColumn("departure_date", F.trunc("departure_ts", "month"))
    path = str(tmp_path / "deliveries")
    deliveries.withColumn("departure_date", F.col("departure_ts").cast("date")).where(
        "departure_ts between '1996-02-01' and '1996-02-20'"
    ).write.partitionBy("departure_date").parquet(path)
    stored = spark.read.parquet(path)
    few = scenario(
        "six_day_by_date", stored, t.customers(spark, SF), calendar=Calendar.of(spark, date(1996, 2, 5))
    )
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(departure_date" in plan
    whole = report("six_day_by_date", spark, SF).where("as_of = '1996-02-05'")
    assert few.exceptAll(whole).isEmpty() and whole.count() == few.count()


@pytest.mark.parametrize("name", SCENARIOS)
def test_no_cross_join_in_any_plan(spark, name):
    plan = report(name, spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_totals_count_customers_without_a_place(spark):
    customers = [(1, "A", "", "n/a", "1", 1, 1, "1", 0, 1, 1, 2), (2, "B", "", "-3.5", "-38", 1, 1, "1", 0, 1, 1, 2)]
    tables = frames(spark, [(i, i, 38, 1, i, MON, 1.0, 10.0) for i in (1, 2)], customers)
    rows = scenario("same_day_by_driver", *tables, calendar=Calendar.of(spark, MON.date()))
    totals = reports.report_totals(rows).first()
    assert (totals.customers, totals.revenue) == (2, 20.0)
    assert {r.driver_name: r.revenue for r in reports.driver_totals(rows).collect()} == {"D1": 10.0, "D2": 10.0}
    box = reports.bounding_box(rows, (-3.0, -39.0)).first()
    assert (box.min_lat, box.min_lon, box.max_lat, box.max_lon) == (-3.5, -39.0, -3.0, -38.0)
    assert reports.bounding_box(rows.where("customer_id = 1"), (-3.0, -39.0)).isEmpty()


@pytest.mark.parametrize(("bound", "limit"), [(100, 100), (None, 100), (100, 0), (None, 0)])
def test_legends(spark, bound, limit):
    noon = MON.replace(hour=12)
    deliveries = [
        (1, 1, 38, 1, 2, MON, 1.0, 1000.5),
        (2, 2, 38, 1, 1, noon, 1.0, 10.0),
        (3, 3, 38, 1, 3, noon, 1.0, 5.0),
    ]
    tables = frames(spark, deliveries)
    day = Calendar.of(spark, SAT.date())
    rows = reports.legend(scenario("same_day_by_driver", *tables, calendar=day), "same_day_by_driver", bound, limit)
    got = [tuple(r)[1:] for r in rows.orderBy("position").collect()]
    totals = (3, 1015.5, "R$ 1.015,50", "03/06/2024")
    assert got == [
        (*totals, 0, "D2", "red", 1000.5, "R$ 1.000,50"),
        (*totals, 1, "D1", "blue", 10.0, "R$ 10,00"),
    ]
    nobody = reports.legend(
        scenario("same_day_by_driver", *tables, calendar=day).where("driver_name is null"),
        "same_day_by_driver",
        bound,
        limit,
    ).collect()
    assert [tuple(r)[1:6] for r in nobody] == [(1, 5.0, "R$ 5,00", "03/06/2024", None)]
    times = reports.legend(scenario("six_day_by_date", *tables, calendar=day), "six_day_by_date", bound, limit)
    assert [(r.legend_date, r.entry, r.color, r.entry_revenue) for r in times.orderBy("position").collect()] == [
        ("01/06/2024", "03/06/2024", "red", None),
        ("01/06/2024", "03/06/2024", "blue", None),
    ]


@pytest.mark.parametrize("bound", [100, None])
def test_palettes_follow_the_first_departure(spark, bound):
    deliveries = [(1, 1, 38, 1, 2, MON, 1.0, 1.0), (2, 2, 38, 1, 1, MON.replace(hour=12), 1.0, 10.0)]
    tables = frames(spark, deliveries)
    day = Calendar.of(spark, MON.date())
    drivers = reports.route_palette(scenario("same_day_by_driver", *tables, calendar=day), bound)
    assert {r.driver_name: (r.position, r.color) for r in drivers.collect()} == {"D2": (0, "red"), "D1": (1, "blue")}
    times = reports.date_palette(scenario("six_day_by_date", *tables, calendar=day), bound)
    assert {r.departure_ts.hour: r.color for r in times.collect()} == {8: "red", 12: "blue"}


def test_decimal_amounts_are_summed_as_decimals(spark):
    deliveries = [(i, 1, 38, 1, 2, MON, 1.0, 0.1) for i in range(30)] + [(30, 1, 38, 1, 2, MON, None, None)]
    made, *others = frames(spark, deliveries)
    exact = made.withColumn("revenue", F.col("revenue").cast("decimal(18,2)"))
    exact = exact.select(*[F.col(c).alias(old) for old, c in SOURCE_COLUMNS["deliveries"].items()])
    rows = scenario(
        "same_day_by_driver", from_source_names("deliveries", exact), *others, calendar=Calendar.of(spark, MON.date())
    )
    assert rows.first().revenue == Decimal("3.00")
    assert reports.report_totals(rows).first().revenue == Decimal("3.00")
    assert reports.legend(rows, "same_day_by_driver").first().total_text == "R$ 3,00"


def test_stop_details_have_defaults_for_missing_columns(spark):
    frame = spark.createDataFrame([(1, None)], "customer_id long, trade_name string")
    row = reports.stop_details(frame).first()
    assert tuple(row) == (1, "", "-", "-", "🕒 DIURNO", "0.00 kg", "R$ 0,00", "-", "-")


CLIENTS = [
    (1, "A", "Ann", "-3.5", "-38", 1, 1, None, 0, 1, 2, 3),
    (2, "B", "Bob", "95.5", "-38", 1, 1, None, 0, 1, 2, 3),  # off the globe
    (3, "C", "Cy", "-3.5", "-38", 1, 1, None, 0, 2, 9, None),  # area without a label
    (4, "D", "Di", "-3.5", "-38", 1, 1, None, 0, 3, 9, None),  # area left out
    (5, "E", "Ed", "-3.5", "-38", 1, 0, None, 0, 1, 1, 1),  # no client
    (6, "F", "Flo", "-3.5", "-38", 2, 1, None, 0, 1, 1, 1),  # not active
    (7, "G", "Gil", " -3.5 ", "-38", 1, 1, None, 0, 4, 99, None),  # partners unknown
    (8, "H", "Hal", "-3.5", "-38", 1, 1, None, 0, None, 1, 1),  # no area
]
LABELS = [(1, "1 - L81-A"), (2, None), (3, "999 - L80-INDUSTRIA"), (4, "4 - x L82 y")]


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_customer_master(spark, limit):
    _, customers, _, areas = frames(spark, [], CLIENTS, areas=LABELS)
    master = masters.customer_master(customers, areas, limit=limit)
    rows = {r.customer_id: r for r in master.collect()}
    basic = masters.customer_master(customers, areas, extended=False, limit=limit)
    assert "region" not in basic.columns and basic.count() == 2
    assert sorted(rows) == ["1", "7"]
    first, second = rows["1"], rows["7"]
    assert (first.vendor_name, first.supervisor, first.region, first.network) == ("Bob", "Cy", "L81-CAPITAL", "")
    assert (second.vendor_name, second.supervisor, second.region, second.lat) == (None, "N/A", "L82-INTERIOR", -3.5)
    assert masters.master_summary(master).first()[0] == 2
    assert tuple(masters.centroid(master).first()) == (-3.5, -38.0)


def test_calendar_of_a_frame(spark):
    days = spark.createDataFrame([(date(2024, 6, d),) for d in (3, 1, 3)] + [(None,)], "as_of date")
    calendar = Calendar.from_frame(days)
    assert (calendar.first.day, calendar.last.day, calendar.gapless, calendar.days.count()) == (1, 3, False, 2)
    assert Calendar.from_frame(days.where("as_of is null")) is None
    assert Calendar.of(spark, date(2024, 6, 2), date(2024, 6, 1)).gapless


@pytest.mark.parametrize("name", ["six_day_by_date", "next_day_by_driver", "interior_mon_tue"])
def test_scattered_days_prune_the_partitions_of_a_store(spark, tmp_path, name):
    """Only the dates that some report day looks at are read of a table partitioned by the date."""
    dated = t.deliveries(spark, SF).withColumn("departure_date", F.col("departure_ts").cast("date"))
    near = dated.where("departure_ts between '1996-02-01' and '1996-05-31'")
    path = str(tmp_path / "deliveries")
    near.repartition("departure_date").write.partitionBy("departure_date").parquet(path)
    tables = (t.customers(spark, SF), t.drivers(spark, SF), t.areas(spark, SF))
    days = [date(1996, m, d) for m in (2, 3, 4) for d in (4, 7, 12, 15, 19, 22, 26)]
    frame = spark.createDataFrame([(d,) for d in days], "as_of date")
    for calendar in (Calendar.of(spark, *days), Calendar.from_frame(frame)):
        found = scenario(name, spark.read.parquet(path), *tables, calendar=calendar)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SubqueryAdaptiveBroadcast dynamicpruning" in plan
        whole = scenario(name, t.deliveries(spark, SF), *tables, calendar=calendar)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, whole.collect()))
    assert found.count() > 0


def test_no_day_is_not_every_day(spark, tmp_path):
    """The report of scattered days over orders of which none is near a fifteenth."""
    for name in ("customer", "orders", "lineitem", "supplier", "nation"):
        rows = spark.read.parquet(f"{SF}/{name}.parquet")
        if name == "orders":
            rows = rows.where("o_orderdate between '1996-02-02' and '1996-02-12'")
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    assert QUERIES["same_day_by_driver"](spark, str(tmp_path)).count() > 0
    assert QUERIES["scattered_days"](spark, str(tmp_path)).count() == 0


def test_reports_do_without_a_driver_column(spark):
    """Every row is then of the one unknown driver, and the texts of a stop say that it is missing."""
    tables = frames(spark, [(i, i, 38, 1, 1, MON.replace(hour=5 + i), 1.0, 2.0) for i in range(1, 5)])
    rows = scenario("same_day_by_driver", *tables, calendar=Calendar.of(spark, MON.date())).drop("driver_name")
    assert [tuple(r) for r in reports.driver_totals(rows).collect()] == [(MON.date(), UNKNOWN_DRIVER, 8.0)]
    (entry,) = reports.legend(rows, "same_day_by_driver").collect()
    assert (entry.entry, entry.entry_revenue, entry.total_customers) == (UNKNOWN_DRIVER.upper(), 8.0, 4)
    (color,) = reports.route_palette(rows).collect()
    assert (color.driver_name, color.position) == (UNKNOWN_DRIVER, 0)
    stops = ensure_column(rows, "driver_name", UNKNOWN_DRIVER)
    walked = route_stops(stops, ["as_of", "driver_name"], CITY_DEPOT, rows_per_route=10)
    assert sorted(r.visit_seq for r in walked.collect()) == [1, 2, 3, 4]
    details = reports.stop_details(walked.drop("driver_name")).collect()
    assert {r.driver_text for r in details} == {MISSING_TEXT}
