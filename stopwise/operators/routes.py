"""Visit sequences: which stop of a route comes when."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

import stopwise
from stopwise.constants import DEFAULT_PRIORITY
from stopwise.functions.geo import haversine_km, in_range, is_point
from stopwise.functions.text import priority_block
from stopwise.operators.greedy import SHORT, greedy_walk, walk_blocks, walk_side_by_side
from stopwise.operators.numbering import number_within
from stopwise.operators.storage import BROADCAST_BYTES, Scratch, broadcast_checked, row_bytes

# The walk travels to the executors with the query, so they need not have this package installed.
register_pickle_by_value(stopwise)

# Stops that one task may hold as one route. Longer routes are walked in several rounds.
ROUTE_ROWS = 200_000

# Distance rings used to choose how much of a long route a round loads: this many per doubling.
_RINGS_PER_DOUBLING = 32
_NO_DISTANCE = -100 * _RINGS_PER_DOUBLING

# Bytes of eight numbers, more than a place or the state of a route has besides its keys.
_NUMBERS = 64

DEFAULT_TIES = ("departure_ts", "customer_id")


def placeable(df: DataFrame, check_range: bool = False) -> DataFrame:
    """Rows that have a place on the map; ``check_range`` also asks for it to be on the globe."""
    lat, lon = F.col("lat"), F.col("lon")
    return df.where(in_range(lat, lon) if check_range else is_point(lat, lon))


def ensure_column(df: DataFrame, name: str, default) -> DataFrame:
    return df if name in df.columns else df.withColumn(name, F.lit(default))


def route_stops(
    df: DataFrame,
    keys: list[str],
    depot: tuple[float, float],
    ties=DEFAULT_TIES,
    rows_per_route: int | None = None,
    limit: int = ROUTE_ROWS,
    ordered: bool = False,
) -> DataFrame:
    """Number the stops of every route: priority blocks in turn, the nearest remaining stop first.

    ``keys`` name the route, ``ties`` (unique within a route) decide between stops at the same
    distance, and rows without a route or a place are left out. ``rows_per_route`` is a bound the
    caller has proved: a report has one row per customer and day, for example, so no route of it is
    longer than the customer table. If the bound fits one task, or the routes counted fit, each
    route is walked in one task. Longer ones are walked in rounds, to the same result.
    """
    present = [F.col(k).isNotNull() for k in keys]
    stops = placeable(df)
    for condition in present:
        stops = stops.where(condition)
    stops = ensure_column(stops, "priority", DEFAULT_PRIORITY).withColumn("block", priority_block(F.col("priority")))
    if rows_per_route is not None and rows_per_route <= limit:
        numbered = _walk_short(stops, keys, depot, ties)
    else:
        numbered = _walk_counted(stops, keys, depot, ties, limit)
    return numbered.orderBy(*keys, "visit_seq") if ordered else numbered


def greedy_sequence(
    df: DataFrame, keys: list[str], start: tuple[float, float], ties=DEFAULT_TIES, **bounds
) -> DataFrame:
    """Number the stops of every route by the nearest remaining one alone, whatever their priority."""
    kept = df.withColumnsRenamed({"priority": "_priority"})
    walked = route_stops(kept, keys, start, ties, **bounds).drop("priority", "block")
    return walked.withColumnsRenamed({"_priority": "priority"})


def last_locations(stops: DataFrame, keys: list[str]) -> DataFrame:
    """Where each route ends; a route without a placed stop has no row."""
    end = F.max_by(F.struct("lat", "lon"), "visit_seq").alias("end")
    return stops.groupBy(*keys).agg(end).select(*keys, "end.lat", "end.lon")


def _walk_counted(stops: DataFrame, keys: list[str], depot, ties, limit: int) -> DataFrame:
    """Walk routes of unknown length: count them first, then tell the short from the long ones."""
    scratch = Scratch(stops.sparkSession, "routes")
    stops = scratch.save(stops, "stops")
    lengths = stops.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    long_routes = scratch.save(lengths.where(F.col("_rows") > limit).drop("_rows"), "long")
    if long_routes.isEmpty():
        return _walk_short(stops, keys, depot, ties)
    marks = broadcast_checked(long_routes)
    short = _walk_short(stops.join(marks, keys, "left_anti"), keys, depot, ties)
    long = _number_long(stops.join(marks, keys, "left_semi"), keys, depot, ties, limit)
    return short.unionByName(long)


def _walk_short(stops: DataFrame, keys: list[str], depot, ties) -> DataFrame:
    # The window shuffles by route and sorts by block and tie-break; its number 1 marks each route's
    # first row, so that tasks can tell routes apart while they read the sorted rows as a stream.
    # The number of tasks is given, as adaptive execution would join partitions until they have bytes
    # enough: a walk takes far longer than reading its stops, and the last task would walk for all.
    tasks = int(stops.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    window = Window.partitionBy(*keys).orderBy("block", *ties)
    ready = stops.repartition(tasks, *keys).withColumn("visit_seq", F.row_number().over(window))
    return ready.mapInArrow(partial(_sequence_batches, depot=depot), ready.schema)


def _routes_in(batches: Iterator[pa.RecordBatch], counter: str) -> Iterator[pa.Table]:
    """Cut a stream of sorted rows into tables of whole routes; ``counter`` is 1 where one begins."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        starts = np.flatnonzero(batch.column(counter).to_numpy(zero_copy_only=False) == 1)
        if len(starts) and (waiting or starts[-1] > 0):
            yield pa.Table.from_batches([*waiting, batch.slice(0, starts[-1])])
            waiting = []
            batch = batch.slice(starts[-1])
        waiting.append(batch)
    if waiting:
        yield pa.Table.from_batches(waiting)


def _replace(table: pa.Table, name: str, values: np.ndarray) -> pa.Table:
    at = table.schema.get_field_index(name)
    return table.set_column(at, table.schema.field(at), pa.array(values, type=table.schema.field(at).type))


def _numpy(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _sequence_batches(batches: Iterator[pa.RecordBatch], depot: tuple[float, float]) -> Iterator[pa.RecordBatch]:
    start = tuple(map(math.radians, depot))
    for table in _routes_in(batches, "visit_seq"):
        lat, lon = np.radians(_numpy(table, "lat")), np.radians(_numpy(table, "lon"))
        block = _numpy(table, "block")
        begins = np.flatnonzero(_numpy(table, "visit_seq") == 1)
        sizes = np.diff([*begins, len(lat)])
        visit = np.ones(len(lat), dtype=np.int32)
        short = np.repeat((sizes > 1) & (sizes <= SHORT), sizes)
        if short.any():
            route = np.repeat(np.arange(len(sizes)), sizes)[short]
            visit[short] = walk_side_by_side(lat[short], lon[short], block[short], route, start)
        for begin, size in zip(begins[sizes > SHORT], sizes[sizes > SHORT]):
            stops = slice(begin, begin + size)
            visit[stops] = walk_blocks(lat[stops], lon[stops], block[stops], start)
        yield from _replace(table, "visit_seq", visit).to_batches()


# Long routes ------------------------------------------------------------------------------------


def _number_long(stops: DataFrame, keys: list[str], depot, ties, limit: int) -> DataFrame:
    """Visit numbers of routes that are too long for one task.

    Stops at the same place are visited one after the other, so the walk goes over distinct places
    only, which Spark combines before the shuffle; the stops are numbered from the order of places.
    """
    place = [*keys, "block", "lat", "lon"]
    first_tie = F.min(F.struct(*ties)).alias("tie")
    sites = stops.groupBy(*place).agg(first_tie)
    walked = _walk_sites(sites, keys, depot, limit)
    numbered = stops.join(walked, place)
    order = [F.col("site_seq"), *[F.col(t) for t in ties]]
    seq = number_within(numbered, keys, order, "visit_seq", limit=limit)
    return seq.withColumn("visit_seq", F.col("visit_seq").cast("int")).drop("site_seq")


def _walk_sites(sites: DataFrame, keys: list[str], depot, limit: int) -> DataFrame:
    """Walk the places of long routes in rounds, all routes side by side.

    A round takes from every route the remaining places of its current block around its current
    location: as many whole distance rings as one task may hold. The walk over them is final up to
    the step at which a place not loaded could be nearer (by the triangle inequality, when the next
    step is longer than the loaded radius less the distance from where the round began). If the
    first ring alone is too full, only the nearest place is loaded and the round takes that one step.
    Every round visits at least one place of every route and writes the places visited, nothing else
    of their size. What is left is the places without the visits logged since they were last written;
    they are written anew when half of them are visited, so all rounds together write each place a
    few times at most. A lost executor costs the tasks of one round.
    """
    scratch = Scratch(sites.sparkSession, "long-routes")
    place = [*keys, "block", "lat", "lon"]
    places = scratch.save(sites, "places=0")
    found = places.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    left, routes, widest = found.agg(F.sum("n"), F.count(F.lit(1)), F.max(row_bytes(found))).first()
    written = left
    # The tables by route have a few numbers each besides the keys.
    per_route = F.broadcast if routes * (widest + _NUMBERS) <= BROADCAST_BYTES else lambda table: table
    here = places.select(*keys).distinct().withColumns(
        {"at_lat": F.lit(depot[0]), "at_lon": F.lit(depot[1]), "walked": F.lit(0)}
    )
    step, first_logged, visited = 0, 1, None
    while left:
        step += 1
        remaining = places
        if step > first_logged:
            log = scratch.read(f"visited={{{','.join(map(str, range(first_logged, step)))}}}", visited).select(*place)
            small = (written - left) * (widest + _NUMBERS) <= BROADCAST_BYTES
            remaining = places.join(F.broadcast(log) if small else log, place, "left_anti")
            if 2 * left <= written:
                places = remaining = scratch.save(remaining, f"places={step}")
                written, first_logged = left, step
        away = _with_rings(remaining.join(per_route(here), keys))
        loads = scratch.save(_choose_load(away, keys, limit), f"load={step}")
        chosen = away.join(per_route(loads), [*keys, "block"])
        loaded = chosen.where(F.col("ring") <= F.col("last_ring"))
        if not loads.where(F.col("last_ring").isNull()).isEmpty():
            loaded = loaded.unionByName(_nearest_only(chosen, keys))
        visited = scratch.save(_walk_round(loaded, keys), f"visited={step}")
        left -= visited.count()
        # A route that is not at its end was on its way in this round.
        ends = visited.groupBy(*keys).agg(F.max(F.struct("site_seq", "lat", "lon")).alias("end"))
        here = ends.select(
            *keys, F.col("end.lat").alias("at_lat"), F.col("end.lon").alias("at_lon"), F.col("end.site_seq").alias("walked")
        )
    return scratch.read("visited=*", visited)


def _with_rings(places: DataFrame) -> DataFrame:
    km = haversine_km(F.col("at_lat"), F.col("at_lon"), F.col("lat"), F.col("lon"))
    ring = F.when(F.col("km") > 0, F.floor(F.log2("km") * _RINGS_PER_DOUBLING)).otherwise(F.lit(_NO_DISTANCE))
    return places.withColumn("km", km).withColumn("ring", ring.cast("int"))


def _choose_load(away: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Per route: its current block, the last ring to load (null if not even one fits) and the radius."""
    rings = away.groupBy(*keys, "block", "ring").agg(F.count(F.lit(1)).alias("places"))
    # A route has a few thousand rings at most, however many places lie in them.
    route = Window.partitionBy(*keys)
    outward = route.orderBy("ring")
    current = rings.withColumn("_first", F.min("block").over(route)).where("block = _first").drop("_first")
    filled = current.withColumn("inside", F.sum("places").over(outward))
    per_route = filled.groupBy(*keys, "block").agg(
        F.max(F.when(F.col("inside") <= limit, F.col("ring"))).alias("last_ring"),
        F.max("ring").alias("outer_ring"),
        F.min("ring").alias("first_ring"),
    )
    edge = F.pow(F.lit(2.0), (F.col("last_ring") + 1) / F.lit(float(_RINGS_PER_DOUBLING)))
    reach = F.when(F.col("last_ring") == F.col("outer_ring"), F.lit(float("inf"))).otherwise(edge)
    return per_route.withColumn("reach_km", F.coalesce(reach, F.lit(0.0))).drop("outer_ring")


def _nearest_only(chosen: DataFrame, keys: list[str]) -> DataFrame:
    names = [c for c in chosen.columns if c not in keys]
    innermost = chosen.where(F.col("last_ring").isNull() & (F.col("ring") == F.col("first_ring")))
    packed = F.struct("km", "tie", *[c for c in names if c not in ("km", "tie")])
    return innermost.groupBy(*keys).agg(F.min(packed).alias("row")).select(*keys, "row.*").select(chosen.columns)


def _walk_round(loaded: DataFrame, keys: list[str]) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy("tie")
    columns = [*keys, "block", "lat", "lon", "at_lat", "at_lon", "walked", "reach_km"]
    ready = loaded.withColumn("site_seq", F.row_number().over(window)).select(*columns, "site_seq")
    schema = T.StructType([f for f in ready.schema if f.name not in ("at_lat", "at_lon", "walked", "reach_km")])
    return ready.mapInArrow(_walk_batches, schema)


def _walk_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _routes_in(batches, "site_seq"):
        lat, lon = np.radians(_numpy(table, "lat")), np.radians(_numpy(table, "lon"))
        at_lat, at_lon = np.radians(_numpy(table, "at_lat")), np.radians(_numpy(table, "at_lon"))
        walked, reach = _numpy(table, "walked"), _numpy(table, "reach_km")
        begins = np.flatnonzero(_numpy(table, "site_seq") == 1)
        rows, seq = [], []
        for begin, end in zip(begins, [*begins[1:], len(lat)]):
            start = (at_lat[begin], at_lon[begin])
            order, _ = greedy_walk(lat[begin:end], lon[begin:end], start, reach[begin])
            rows.append(begin + order)
            seq.append(walked[begin] + np.arange(1, len(order) + 1))
        taken = table.take(pa.array(np.concatenate(rows)))
        taken = _replace(taken, "site_seq", np.concatenate(seq).astype(np.int32))
        yield from taken.drop_columns(["at_lat", "at_lon", "walked", "reach_km"]).to_batches()
