"""The registered queries. Each takes a session and the folder of the given tables."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.constants import CITY_DEPOT
from stopwise.functions.colors import hash_color
from stopwise.functions.geo import haversine_km
from stopwise.functions.text import priority, to_number
from stopwise.operators import facet_index, facets, palettes, paths
from stopwise.operators.calendar import Calendar
from stopwise.operators.roster import assign_roster, enrich_networks
from stopwise.operators.sorted_runs import SortedRuns
from stopwise.operators.routes import greedy_sequence, last_locations, placeable, route_stops
from stopwise.operators.storage import Scratch, row_bound
from stopwise.plans import master as masters
from stopwise.plans import reports
from stopwise.plans.scenarios import SCENARIOS, find_scenario, route_keys, scenario
from stopwise.schemas import NETWORK_COLUMNS, ROSTER_COLUMNS
from stopwise.sources.sinks import read_report, write_report
from stopwise.sources.tables import load_tables, read_networks, read_roster
from stopwise.streaming.refresh import refresh_stream
from workload import tables as t

SELECTION = {
    "region": ["L81-CAPITAL", "L82-INTERIOR"],
    "supervisor": ["Customer#000000003", "Customer#000000004", "N/A"],
}
SEARCHES = (("area", "l82-nation_1"), ("customer", "er#00000001"), ("vendor", "00099"), ("network", "t_"), ("id", "123"))
ONE_SUPERVISOR = {"supervisor": ["Customer#000000003"]}


# Shared steps -----------------------------------------------------------------------------------


def report(
    name: str, spark: SparkSession, sf: str, calendar: Calendar | None = None, roster: DataFrame | None = None
) -> DataFrame:
    return scenario(
        name,
        t.deliveries(spark, sf),
        t.customers(spark, sf),
        t.drivers(spark, sf),
        t.areas(spark, sf),
        calendar=calendar or t.whole_calendar(spark, sf),
        roster=t.roster(spark, sf) if roster is None else roster,
    )


def customer_count(spark: SparkSession, sf: str) -> int:
    """Rows of the customer table, from its footers: no route, facet or palette can be longer."""
    return row_bound(t.table(spark, sf, "customer"))


def driver_count(name: str, spark: SparkSession, sf: str) -> int:
    """Drivers there are: no legend of a day has more. A roster's are at most its lines, and the fallback."""
    if name == "interior_eight_day_by_roster":
        return 2 * row_bound(t.table(spark, sf, "nation")) + 1
    return row_bound(t.table(spark, sf, "supplier"))


def stops_of(name: str, spark: SparkSession, sf: str) -> DataFrame:
    depot = find_scenario(name).depot
    return route_stops(report(name, spark, sf), route_keys(name), depot, rows_per_route=customer_count(spark, sf))


def nation_points(spark: SparkSession, sf: str) -> DataFrame:
    """All customers as stops, one route per nation: few, long routes."""
    key = F.col("c_custkey")
    return t.table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("nation_key"),
        key.alias("customer_id"),
        (F.lit(-3.0) - ((key * 7919) % 10007) / F.lit(10007.0) * 2.0).alias("lat"),
        (F.lit(-38.0) - ((key * 104729) % 10009) / F.lit(10009.0) * 2.5).alias("lon"),
        F.when(key % 4 != 0, key % 4).otherwise(3).cast("int").alias("priority"),
    )


def nation_stops(spark: SparkSession, sf: str, **how) -> DataFrame:
    return route_stops(nation_points(spark, sf), ["nation_key"], CITY_DEPOT, ["customer_id"], **how)


def bounded_nation_stops(spark: SparkSession, sf: str) -> DataFrame:
    return nation_stops(spark, sf, rows_per_route=customer_count(spark, sf))


def master(spark: SparkSession, sf: str) -> DataFrame:
    return masters.customer_master(
        t.customers(spark, sf), t.areas(spark, sf), t.networks(spark, sf), excluded_areas=t.EXCLUDED
    )


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns if c in df.columns})


def _report_shape(df: DataFrame) -> DataFrame:
    return _rounded(_rounded(df, 6, "lat", "lon"), 2, "weight_kg", "revenue")


# Queries ----------------------------------------------------------------------------------------


def scenario_report(name: str, spark: SparkSession, sf: str) -> DataFrame:
    return _report_shape(report(name, spark, sf))


def scattered_days(spark: SparkSession, sf: str) -> DataFrame:
    """The six-day report for the fifteenth of every month only; no rows if no month has one."""
    days = Calendar.from_frame(t.whole_calendar(spark, sf).days.where(F.day("as_of") == 15))
    rows = report("six_day_by_date", spark, sf, days)
    return _report_shape(rows if days is not None else rows.where(F.lit(False)))


def scenario_without_roster(spark: SparkSession, sf: str) -> DataFrame:
    """The roster scenario without its optional file: every driver is the fallback."""
    rows = scenario(
        "interior_eight_day_by_roster",
        t.deliveries(spark, sf),
        t.customers(spark, sf),
        areas=t.areas(spark, sf),
        calendar=t.whole_calendar(spark, sf),
    )
    return _report_shape(rows)


def roster_from_file(spark: SparkSession, sf: str) -> DataFrame:
    """The roster scenario with the roster read from a file whose columns stand in another order."""
    path = f"{Scratch(spark, 'files').root}/roster"
    old_names = {new: old for old, new in ROSTER_COLUMNS.items()}
    # A line for each route and week; in one file, as the last line of a route wins.
    lines = t.roster(spark, sf).orderBy("row_no").select(
        "week_code", "driver_name", "route", F.lit("").alias("route_code"), F.lit("").alias("area_id")
    )
    lines.coalesce(1).withColumnsRenamed(old_names).write.csv(
        path, sep=";", header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    name = "interior_eight_day_by_roster"
    return _report_shape(report(name, spark, sf, roster=read_roster(spark, path)))


def tables_from_parquet(spark: SparkSession, sf: str) -> DataFrame:
    """The same-day report with its tables stored as text where a type can be, and loaded."""
    root = Scratch(spark, "tables").root
    made = {"deliveries": t.deliveries, "customers": t.customers, "drivers": t.drivers, "areas": t.areas}
    for name, make in made.items():
        stored = make(spark, sf)
        if name == "deliveries":
            stored = stored.withColumn("departure_ts", F.col("departure_ts").cast("string"))
        stored.write.parquet(f"{root}/{name}")
    loaded = load_tables(spark, root)
    return _report_shape(scenario("same_day_by_driver", **loaded, calendar=t.whole_calendar(spark, sf)))


def scenario_totals(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(reports.report_totals(report("same_day_by_driver", spark, sf)), 2, "revenue")


def driver_totals(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(reports.driver_totals(report("interior_eight_day_by_roster", spark, sf)), 2, "revenue")


def _legend(name: str, spark: SparkSession, sf: str) -> DataFrame:
    # Departure times have no table to bound them, so they are counted.
    bound = None if name == "six_day_by_date" else driver_count(name, spark, sf) + 1
    rows = reports.legend(report(name, spark, sf), name, bound)
    return _rounded(rows, 2, "total_revenue", "entry_revenue")


def route_palette(spark: SparkSession, sf: str) -> DataFrame:
    return reports.route_palette(
        report("next_day_by_driver", spark, sf), driver_count("next_day_by_driver", spark, sf)
    )


def date_palette(spark: SparkSession, sf: str) -> DataFrame:
    return reports.date_palette(report("six_day_by_date", spark, sf))


def bounding_boxes(spark: SparkSession, sf: str) -> DataFrame:
    boxes = reports.bounding_box(report("six_day_by_date", spark, sf), CITY_DEPOT)
    return _rounded(boxes, 6, "min_lat", "min_lon", "max_lat", "max_lon")


def coordinate_cleaning(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = t.customers(spark, sf).select(
        "customer_id",
        to_number(F.col("lat_raw")).alias("lat"),
        to_number(F.col("lon_raw")).alias("lon"),
        priority(F.col("priority_raw")).alias("priority"),
    )
    return _rounded(placeable(cleaned, check_range=True), 6, "lat", "lon")


def distance_from_depot(spark: SparkSession, sf: str) -> DataFrame:
    points = coordinate_cleaning(spark, sf)
    km = haversine_km(F.lit(CITY_DEPOT[0]), F.lit(CITY_DEPOT[1]), F.col("lat"), F.col("lon"))
    return points.select("customer_id", F.round(km, 6).alias("distance_km"))


def scenario_routes(name: str, spark: SparkSession, sf: str) -> DataFrame:
    keys = route_keys(name)
    return stops_of(name, spark, sf).select(*keys, "customer_id", "block", "visit_seq")


def customer_routes_by_nation(spark: SparkSession, sf: str) -> DataFrame:
    return bounded_nation_stops(spark, sf).select("nation_key", "customer_id", "block", "visit_seq")


def customer_routes_in_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """The same routes as if a task could hold only half of one: walked in rounds, to the same result."""
    half_a_route = max(1, customer_count(spark, sf) // 50)
    return nation_stops(spark, sf, limit=half_a_route).select("nation_key", "customer_id", "block", "visit_seq")


def unblocked_stops(spark: SparkSession, sf: str) -> DataFrame:
    bound = customer_count(spark, sf)
    return greedy_sequence(nation_points(spark, sf), ["nation_key"], CITY_DEPOT, ["customer_id"], rows_per_route=bound)


def nearest_sequence(spark: SparkSession, sf: str) -> DataFrame:
    return unblocked_stops(spark, sf).select("nation_key", "customer_id", "priority", "visit_seq")


def route_ends(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(last_locations(unblocked_stops(spark, sf), ["nation_key"]), 6, "lat", "lon")


def route_legs(spark: SparkSession, sf: str) -> DataFrame:
    legs = paths.route_legs(bounded_nation_stops(spark, sf), ["nation_key"], CITY_DEPOT)
    return _rounded(
        legs.select("nation_key", "visit_seq", "customer_id", "prev_lat", "prev_lon", "lat", "lon", "leg_km"),
        6, "prev_lat", "prev_lon", "lat", "lon", "leg_km",
    )


def route_lengths(spark: SparkSession, sf: str) -> DataFrame:
    name = "same_day_by_driver"
    legs = paths.route_legs(stops_of(name, spark, sf), route_keys(name), CITY_DEPOT)
    return _rounded(paths.route_lengths(legs, route_keys(name)), 6, "length_km")


def route_path_points(spark: SparkSession, sf: str) -> DataFrame:
    lines = paths.route_path(bounded_nation_stops(spark, sf), ["nation_key"], CITY_DEPOT)
    points = lines.select("nation_key", F.explode("path").alias("point")).select("nation_key", "point.*").distinct()
    return _rounded(points, 6, "lat", "lon")


def stop_details(spark: SparkSession, sf: str) -> DataFrame:
    return reports.stop_details(stops_of("interior_eight_day_by_roster", spark, sf))


def customer_master(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(master(spark, sf), 6, "lat", "lon")


def customer_master_basic(spark: SparkSession, sf: str) -> DataFrame:
    basic = masters.customer_master(
        t.customers(spark, sf), t.areas(spark, sf), excluded_areas=t.EXCLUDED, extended=False
    )
    return _rounded(basic, 6, "lat", "lon")


def customer_networks(spark: SparkSession, sf: str) -> DataFrame:
    return enrich_networks(t.customers(spark, sf).select("customer_id"), t.networks(spark, sf))


def networks_from_file(spark: SparkSession, sf: str) -> DataFrame:
    """The same enrichment with the networks read from a CSV file."""
    path = f"{Scratch(spark, 'files').root}/networks"
    old_names = {new: old for old, new in NETWORK_COLUMNS.items()}
    lines = t.networks(spark, sf).withColumnsRenamed(old_names)
    lines.write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return enrich_networks(t.customers(spark, sf).select("customer_id"), read_networks(spark, path))


def region_counts(spark: SparkSession, sf: str) -> DataFrame:
    return masters.region_counts(master(spark, sf))


def master_summary(spark: SparkSession, sf: str) -> DataFrame:
    return masters.master_summary(master(spark, sf))


def centroid(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(masters.centroid(master(spark, sf)), 6, "lat", "lon")


def value_bound(spark: SparkSession, sf: str) -> int:
    """Customers and network lines: a facet has at most one value of each."""
    lines = t.networks(spark, sf).select(F.lit(1)).count()
    return customer_count(spark, sf) + lines


def facet_values(spark: SparkSession, sf: str) -> DataFrame:
    return facets.facet_values(master(spark, sf), value_bound(spark, sf))


def facet_values_in_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The same positions from sorted runs to which the values are added in three parts."""
    runs = SortedRuns(spark, f"{Scratch(spark, 'runs').root}/values", run_rows=1_000)
    values = Scratch(spark, "facets").save(facet_values(spark, sf).select("facet", "value"), "values")
    for part in range(3):
        runs.add(values.where(F.pmod(F.xxhash64("value"), F.lit(3)) == part))
    return runs.values()


def facet_search(spark: SparkSession, sf: str) -> DataFrame:
    return facets.facet_search(facet_values(spark, sf), "area", "l82-nation_1")


def facet_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(facets.facet_filter(master(spark, sf), SELECTION), 6, "lat", "lon")


def facet_filter_summary(spark: SparkSession, sf: str) -> DataFrame:
    return facets.facet_filter_summary(facets.facet_filter(master(spark, sf), SELECTION))


def facet_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of many selections from the index: each supervisor with the capital or the interior, and everything."""
    rows = master(spark, sf)
    region = F.explode(F.array(F.lit("L81-CAPITAL"), F.lit("L82-INTERIOR"))).alias("region")
    pairs = rows.select("supervisor").distinct().select("supervisor", region)
    selection = F.concat_ws(" / ", "supervisor", "region")
    values = F.array(
        F.struct(F.lit("supervisor").alias("facet"), F.col("supervisor").alias("value")),
        F.struct(F.lit("region").alias("facet"), F.col("region").alias("value")),
        # Two areas, either of which will do, and a network or none.
        F.struct(F.lit("network").alias("facet"), F.lit("").alias("value")),
        F.struct(F.lit("network").alias("facet"), F.lit("NET_3").alias("value")),
    )
    chosen = pairs.select(selection.alias("selection"), F.explode(values).alias("pair")).select("selection", "pair.*")
    everything = spark.createDataFrame([("everything", None, None)], "selection string, facet string, value string")
    return facet_index.facet_summaries(facet_index.build_facet_index(rows), chosen.unionByName(everything))


def facet_search_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """Searches in facet values through the index of their pieces."""
    index = facet_index.build_value_index(facet_values(spark, sf))
    found = [
        facet_index.indexed_search(index, facet, term).withColumn("term", F.lit(term)) for facet, term in SEARCHES
    ]
    return reduce(DataFrame.unionByName, found)


def facet_select_all(facet: str, spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(facets.facet_select_all(master(spark, sf), facet), 6, "lat", "lon")


def visible_vendors(spark: SparkSession, sf: str) -> DataFrame:
    return facets.visible_vendors(facets.facet_filter(master(spark, sf), SELECTION))


def supervisor_palette(spark: SparkSession, sf: str) -> DataFrame:
    return palettes.supervisor_palette(master(spark, sf))


def vendor_palette(spark: SparkSession, sf: str) -> DataFrame:
    shown = facets.facet_filter(master(spark, sf), ONE_SUPERVISOR)
    return palettes.vendor_palette(shown)


def master_legend(spark: SparkSession, sf: str) -> DataFrame:
    return palettes.master_legend(master(spark, sf), ONE_SUPERVISOR)


def hash_colors(spark: SparkSession, sf: str) -> DataFrame:
    names = t.customers(spark, sf).select(F.col("person_name").alias("name")).distinct()
    return names.select("name", hash_color(F.col("name")).alias("color"))


def colored_markers(spark: SparkSession, sf: str) -> DataFrame:
    colored = palettes.colored_master(master(spark, sf), ONE_SUPERVISOR)
    return _rounded(colored, 6, "lat", "lon")


def customer_markers(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(palettes.customer_markers(master(spark, sf)), 6, "lat", "lon")


def palette_json(spark: SparkSession, sf: str) -> DataFrame:
    return palettes.palette_json(supervisor_palette(spark, sf))


def roster_of_customers(spark: SparkSession, sf: str) -> DataFrame:
    """The roster's driver of every customer, by the route in the customer's area."""
    placed = t.customers(spark, sf).join(t.areas(spark, sf), "area_id", "left")
    return assign_roster(placed, t.roster(spark, sf)).select("customer_id", "area_desc", "driver_name")


def written_report(spark: SparkSession, sf: str) -> DataFrame:
    """A report written by day, read back."""
    path = f"{Scratch(spark, 'reports').root}/written"
    days = t.whole_calendar(spark, sf).days
    write_report(report("same_day_by_driver", spark, sf), path, "same_day_by_driver", days)
    written = read_report(spark, path, "same_day_by_driver")
    return _report_shape(written.withColumn("scenario", F.lit("same_day_by_driver")))


def stream_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """The same-day report built by the stream that watches the orders, which come in three parts.

    The parts follow the order date. Every seventh order also comes as a draft, an older version that
    left three days earlier: with, before or after the order itself.
    """
    root = Scratch(spark, "stream").root
    orders = t.table(spark, sf, "orders").withColumn("version", F.lit(2))
    calendar = t.whole_calendar(spark, sf)
    per_part = ((calendar.last - calendar.first).days + 3) // 3
    part = F.floor(F.date_diff(F.col("o_orderdate").cast("date"), F.lit(calendar.first)) / per_part)
    drafts = orders.where(F.col("o_orderkey") % 7 == 0).withColumns(
        {"o_orderdate": F.col("o_orderdate") - F.expr("interval 3 days"), "version": F.lit(1)}
    )
    arrivals = orders.withColumn("part", part).unionByName(drafts.withColumn("part", F.col("o_orderkey") % 3))
    for i in range(3):
        arrivals.where(F.coalesce("part", F.lit(0)) == i).drop("part").write.mode("append").parquet(f"{root}/arrivals")
        refresh_stream(
            spark.readStream.schema(f"{t.SCHEMAS['orders']}, version int").parquet(f"{root}/arrivals"),
            {"customers": t.customers(spark, sf), "drivers": t.drivers(spark, sf)},
            "same_day_by_driver",
            f"{root}/deliveries",
            f"{root}/report",
            f"{root}/checkpoint",
            key="o_orderkey",
            departs="o_orderdate",
            version="version",
            within=calendar,
            prepare=lambda batch: t.deliveries_of(batch, _lines_of(batch, t.table(spark, sf, "lineitem"))),
            trigger={"availableNow": True},
        ).awaitTermination()
    return _report_shape(read_report(spark, f"{root}/report", "same_day_by_driver"))


def _lines_of(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """The lines of these orders, found before any is summed."""
    keys = orders.select(F.col("o_orderkey").alias("l_orderkey"))
    return lineitem.join(keys, "l_orderkey", "left_semi")


QUERIES = {
    **{name: partial(scenario_report, name) for name in SCENARIOS},
    "scattered_days": scattered_days,
    "scenario_without_roster": scenario_without_roster,
    "tables_from_parquet": tables_from_parquet,
    "scenario_totals": scenario_totals,
    "driver_totals": driver_totals,
    "scenario_legend": partial(_legend, "next_day_by_driver"),
    "date_legend": partial(_legend, "six_day_by_date"),
    "roster_legend": partial(_legend, "interior_eight_day_by_roster"),
    "route_palette": route_palette,
    "date_palette": date_palette,
    "bounding_boxes": bounding_boxes,
    "coordinate_cleaning": coordinate_cleaning,
    "distance_from_depot": distance_from_depot,
    "routes_by_driver": partial(scenario_routes, "same_day_by_driver"),
    "routes_by_date": partial(scenario_routes, "six_day_by_date"),
    "routes_mon_tue": partial(scenario_routes, "interior_mon_tue"),
    "customer_routes_by_nation": customer_routes_by_nation,
    "customer_routes_in_rounds": customer_routes_in_rounds,
    "nearest_sequence": nearest_sequence,
    "route_ends": route_ends,
    "route_legs": route_legs,
    "route_lengths": route_lengths,
    "route_path_points": route_path_points,
    "stop_details": stop_details,
    "customer_master": customer_master,
    "customer_master_basic": customer_master_basic,
    "customer_networks": customer_networks,
    "networks_from_file": networks_from_file,
    "region_counts": region_counts,
    "master_summary": master_summary,
    "centroid": centroid,
    "facet_values": facet_values,
    "facet_values_in_runs": facet_values_in_runs,
    "facet_search": facet_search,
    "facet_filter": facet_filter,
    "facet_filter_summary": facet_filter_summary,
    "facet_summaries": facet_summaries,
    "facet_search_indexed": facet_search_indexed,
    "facet_select_all": partial(facet_select_all, "vendor"),
    "facet_select_all_networks": partial(facet_select_all, "network"),
    "visible_vendors": visible_vendors,
    "supervisor_palette": supervisor_palette,
    "vendor_palette": vendor_palette,
    "master_legend": master_legend,
    "hash_colors": hash_colors,
    "colored_markers": colored_markers,
    "customer_markers": customer_markers,
    "palette_json": palette_json,
    "roster_lookup": roster_of_customers,
    "roster_from_file": roster_from_file,
    "written_report": written_report,
    "stream_refresh": stream_refresh,
}
