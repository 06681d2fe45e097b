"""Visit sequences against a plain walk that measures every distance."""

import math
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from stopwise.constants import CITY_DEPOT
from stopwise.operators import greedy, routes
from stopwise.operators.paths import route_legs, route_lengths, route_path
from stopwise.operators.routes import route_stops

COLUMNS = "route string, customer_id long, lat double, lon double, priority int"


def km(a, b):
    lat1, lon1, lat2, lon2 = map(math.radians, (*a, *b))
    s = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lon2 - lon1) / 2) ** 2
    return 2 * 6371 * math.asin(min(1.0, math.sqrt(s)))


def brute_force(rows, depot):
    """Lexicographic minimum over block, distance and customer at every step."""
    visits = {}
    for route in {r[0] for r in rows if r[0] is not None}:
        left = [r for r in rows if r[0] == route and r[2] is not None and r[3] is not None]
        at, seq = depot, 0
        while left:
            best = min(left, key=lambda r: ({1: 1, 2: 2}.get(r[4], 3), km(at, (r[2], r[3])), r[1]))
            left.remove(best)
            at, seq = (best[2], best[3]), seq + 1
            visits[route, best[1]] = seq
    return visits


def random_rows(seed, sizes, duplicates=0.2):
    rng = random.Random(seed)
    rows, customer = [], 0
    for route, size in sizes.items():
        spots = []
        for _ in range(size):
            customer += 1
            if spots and rng.random() < duplicates:
                lat, lon = rng.choice(spots)
            else:
                lat, lon = -3 - rng.random() * 2, -38 - rng.random() * 2
                spots.append((lat, lon))
            rows.append((route, customer, lat, lon, rng.choice([1, 2, 3, 9, None])))
    rng.shuffle(rows)
    return rows


def visits_of(df):
    return {(r.route, r.customer_id): r.visit_seq for r in df.collect()}


@pytest.mark.parametrize("bound", [10_000, None])
def test_short_routes_match_brute_force(spark, bound):
    rows = random_rows(1, {f"r{i}": n for i, n in enumerate([1, 1, 2, 3, 5, 40, 90, 300, 700])})
    rows += [("none", 9001, None, -38.0, 1), ("r0", 9002, -3.5, None, 1), (None, 9003, -3.5, -38.0, 1)]
    stops = route_stops(
        spark.createDataFrame(rows, COLUMNS), ["route"], CITY_DEPOT, ["customer_id"], rows_per_route=bound
    )
    assert visits_of(stops) == brute_force(rows, CITY_DEPOT)


@pytest.mark.parametrize("limit", [1, 7, 60])
def test_long_routes_are_walked_in_rounds_to_the_same_result(spark, limit):
    sizes = {1: {"hot": 9, "warm": 7}, 7: {"hot": 60, "warm": 25}, 60: {"hot": 150, "warm": 70}}[limit] | {"cold": 5}
    rows = random_rows(2, sizes, duplicates=0.4)
    stops = route_stops(spark.createDataFrame(rows, COLUMNS), ["route"], CITY_DEPOT, ["customer_id"], limit=limit)
    assert visits_of(stops) == brute_force(rows, CITY_DEPOT)


def test_hot_place_and_equal_distances(spark):
    rows = [("a", i, -3.5, -38.5, 3) for i in range(1, 60)]
    rows += [("a", 100 + i, CITY_DEPOT[0] + s * 0.01, CITY_DEPOT[1], 1) for i, s in enumerate((1, -1))]
    frame = spark.createDataFrame(rows, COLUMNS)
    expected = brute_force(rows, CITY_DEPOT)
    for limit in (5, 1000):
        assert visits_of(route_stops(frame, ["route"], CITY_DEPOT, ["customer_id"], limit=limit)) == expected


def test_everything_equally_far_is_walked_one_step_a_round(spark):
    # All places lie on one ring around the depot, more of them than a task may hold.
    rows = [
        ("a", i, 0.5 * math.cos(i * 0.7), 0.5 * math.sin(i * 0.7), 3) for i in range(1, 9)
    ]
    stops = route_stops(spark.createDataFrame(rows, COLUMNS), ["route"], (0.0, 0.0), ["customer_id"], limit=3)
    assert visits_of(stops) == brute_force(rows, (0.0, 0.0))


def test_empty_input(spark):
    frame = spark.createDataFrame([], COLUMNS)
    for bound in (10, None):
        stops = route_stops(frame, ["route"], CITY_DEPOT, ["customer_id"], rows_per_route=bound)
        assert stops.count() == 0


def test_all_stops_in_the_last_block(spark):
    rows = [(r, c, lat, lon, 3) for r, c, lat, lon, _ in random_rows(3, {"x": 30})]
    stops = route_stops(spark.createDataFrame(rows, COLUMNS), ["route"], CITY_DEPOT, ["customer_id"], 100)
    assert visits_of(stops) == brute_force(rows, CITY_DEPOT)


@pytest.mark.parametrize("size", [1, 4, 5, 1000])
def test_legs_and_paths_do_not_depend_on_segments(spark, size):
    rows = random_rows(4, {"a": 20, "b": 1, "c": 8})
    stops = route_stops(spark.createDataFrame(rows, COLUMNS), ["route"], CITY_DEPOT, ["customer_id"], 100)
    legs = route_legs(stops, ["route"], CITY_DEPOT, size)
    by_route = {}
    for r in legs.orderBy("route", "visit_seq").collect():
        at = by_route.setdefault(r.route, [CITY_DEPOT])
        assert (r.prev_lat, r.prev_lon) == at[-1]
        assert r.leg_km == pytest.approx(km(at[-1], (r.lat, r.lon)), abs=1e-9)
        at.append((r.lat, r.lon))
    lengths = {r.route: (r.stops, r.length_km) for r in route_lengths(legs, ["route"]).collect()}
    for route, points in by_route.items():
        total = sum(km(a, b) for a, b in zip(points, points[1:]))
        assert lengths[route] == (len(points) - 1, pytest.approx(total))

    lines = {}
    for r in route_path(stops, ["route"], CITY_DEPOT, size).orderBy("route", "part").collect():
        line = lines.setdefault(r.route, [])
        points = [(p.lat, p.lon) for p in r.path]
        assert not line or line[-1] == points[0]
        line.extend(points if not line else points[1:])
    assert lines == by_route


def test_missing_place_changes_totals_but_not_the_route(spark):
    rows = random_rows(5, {"a": 12})
    extra = [*rows, ("a", 999, None, None, 1)]
    plain, more = (
        visits_of(route_stops(spark.createDataFrame(r, COLUMNS), ["route"], CITY_DEPOT, ["customer_id"], 100))
        for r in (rows, extra)
    )
    assert plain == more
    assert spark.createDataFrame(extra, COLUMNS).agg(F.count("*")).first()[0] == len(rows) + 1


def test_routes_come_in_name_order_when_asked_to(spark):
    rows = random_rows(6, {"Zoe": 4, "ana": 3, "Bob": 9, "Éva": 2})
    frame = spark.createDataFrame(rows, COLUMNS).repartition(7)
    for bound in (100, None):
        stops = route_stops(frame, ["route"], CITY_DEPOT, ["customer_id"], rows_per_route=bound, ordered=True).collect()
        assert [(r.route, r.visit_seq) for r in stops] == [
            (name, i) for name, size in (("Bob", 9), ("Zoe", 4), ("ana", 3), ("Éva", 2)) for i in range(1, size + 1)
        ]


def test_rounds_write_what_they_visit(spark, tmp_path, monkeypatch):
    """Over all rounds, places are written a few times each, not once a round."""
    written = []

    def save(scratch, df, name):
        path = f"{scratch.root}/{name}"
        df.write.parquet(path)
        back = scratch.spark.read.schema(df.schema).parquet(path)
        written.append((name, back.count()))
        return back

    monkeypatch.setattr(routes.Scratch, "save", save)
    rows = random_rows(7, {"long": 400}, duplicates=0)
    rows = [(*r[:4], 3) for r in rows]
    stops = route_stops(spark.createDataFrame(rows, COLUMNS), ["route"], CITY_DEPOT, ["customer_id"], limit=60)
    assert visits_of(stops) == brute_force(rows, CITY_DEPOT)
    rounds = [n for name, n in written if name.startswith("visited=")]
    places = [n for name, n in written if name.startswith("places=")]
    assert sum(rounds) == 400 and len(rounds) > 10
    assert places[0] == 400 and sum(places[1:]) <= 400 and all(2 * b <= a for a, b in zip(places, places[1:]))
    assert all(n <= 1 for name, n in written if name.startswith("load="))


@pytest.mark.parametrize("layout", ["spread", "copies", "grid", "one place"])
@pytest.mark.parametrize("size", [1, 12, 13, 150, 700])
def test_a_walk_searches_rarely_and_takes_the_nearest(monkeypatch, size, layout):
    rng = np.random.default_rng(size)
    lat, lon = -3 - 2 * rng.random(size), -38 - 2.5 * rng.random(size)
    if layout == "copies":
        lat, lon = (x[rng.integers(0, size, size)] for x in (lat, lon))
    elif layout == "grid":
        lat, lon = -3 - rng.integers(0, 20, size) / 10, -38 - rng.integers(0, 20, size) / 10
    elif layout == "one place":
        lat[:], lon[:] = -3.5, -38.5
    lat, lon = np.radians(lat), np.radians(lon)
    start = tuple(np.radians(CITY_DEPOT))
    searches, search = [], greedy._Leaves.nearest
    monkeypatch.setattr(greedy._Leaves, "nearest", lambda self, here: searches.append(1) or search(self, here))
    order, end = greedy.greedy_walk(lat, lon, start)

    left, here, expected = list(range(size)), start, []
    while left:
        stop = left.pop(int(greedy._distance_km(lat[left], lon[left], *here).argmin()))
        expected.append(stop)
        here = (lat[stop], lon[stop])
    assert order.tolist() == expected and end == here
    if layout == "spread":
        assert len(searches) <= 1 + size // 5


def test_routes_are_walked_in_as_many_tasks_as_the_session_names(spark):
    # A few kilobytes: by bytes alone, adaptive execution makes one task of them.
    rows = [(f"r{i % 40}", i, -3.0 - i / 1000, -38.0, 1) for i in range(400)]
    walked = route_stops(spark.createDataFrame(rows, COLUMNS), ["route"], CITY_DEPOT, ["customer_id"], rows_per_route=10)
    tasks = walked.select(F.spark_partition_id().alias("task")).distinct().count()
    assert tasks == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_stops_at_the_same_place_are_visited_together_without_searching(monkeypatch):
    rng = np.random.default_rng(5)
    size = 600
    places = np.radians([[-3.1, -38.1], [-3.2, -38.4], [-4.0, -39.0], [-3.1, -38.2]])
    lat, lon = places[rng.integers(0, len(places), size)].T
    block, start = np.repeat([1, 2], size // 2), (math.radians(-3.7), math.radians(-38.5))
    searches, search = [], greedy._Leaves.nearest
    monkeypatch.setattr(greedy._Leaves, "nearest", lambda self, here: searches.append(1) or search(self, here))
    visit = greedy.walk_blocks(lat, lon, block, start)

    here, expected = start, []
    for stops in np.flatnonzero(block == 1), np.flatnonzero(block == 2):
        left = stops.tolist()
        while left:
            stop = left.pop(int(greedy._distance_km(lat[left], lon[left], *here).argmin()))
            expected.append(stop)
            here = (lat[stop], lon[stop])
    assert np.argsort(visit).tolist() == expected
    assert len(searches) <= 2 * len(places)


def test_neighbours_in_a_long_route_are_compared_with_what_is_around_only():
    rng = np.random.default_rng(6)
    size = 60_000
    lat, lon = np.radians(rng.uniform(-5, -3, size)), np.radians(rng.uniform(-40, -38, size))
    tracemalloc.start()
    stops, lists = next(greedy._neighbours(lat, lon, np.arange(size)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 * size
    lengths = []
    for stop, known in list(zip(stops, lists))[::25]:
        known = known[: known.index(-1)]
        distance = greedy._distance_km(lat, lon, lat[stop], lon[stop])
        distance[stop] = np.inf
        assert known == np.argsort(distance, kind="stable")[: len(known)].tolist()
        lengths.append(len(known))
    assert np.mean(lengths) > 6
