"""The same queries as SQL over the given tables, written the direct way.

Scenarios multiply deliveries over the days, group, rank and keep rank one; routes are recursive
queries that look at every remaining stop in every step. The Spark side does neither, so equal
results also check that its plans are equivalent.
"""

from __future__ import annotations

from stopwise.constants import (
    CAPITAL_OPS,
    CITY_DEPOT,
    DAYTIME_LABEL,
    INTERIOR_DEPOT,
    INTERIOR_GENERAL_OPS,
    INTERIOR_WEEK_OPS,
    PRIORITY_LABELS,
    ROUTE_COLORS,
)
from workload.queries import ONE_SUPERVISOR, SEARCHES, SELECTION
from workload.tables import EXCLUDED, OP_CODES


def _texts(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _numbers(values) -> str:
    return ", ".join(map(str, values))


CALENDAR = """
calendar AS (
  SELECT CAST(d AS DATE) AS as_of FROM (
    SELECT unnest(generate_series(min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE)), INTERVAL 1 DAY)) AS d
    FROM orders))"""

DELIVERIES = f"""
deliveries AS (
  SELECT o_orderkey AS delivery_id, o_custkey AS customer_id,
    [{_numbers(OP_CODES)}][CAST(o_orderkey % {len(OP_CODES)} AS INTEGER) + 1] AS op_code,
    CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 3 ELSE 2 END AS status,
    CASE WHEN o_orderkey % 37 <> 0 THEN o_orderkey % 11 END AS driver_id,
    o_orderdate AS departure_ts,
    w.weight_kg AS weight_kg,
    CASE WHEN o_orderkey % 41 <> 0 THEN o_totalprice END AS revenue
  FROM orders
  LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS weight_kg FROM lineitem GROUP BY l_orderkey) AS w
    ON l_orderkey = o_orderkey)"""

CUSTOMERS = """
customers AS (
  SELECT c_custkey AS customer_id, c_name AS trade_name, c_name AS person_name,
    CASE c_custkey % 29 WHEN 3 THEN 'n/a' WHEN 5 THEN '95.5' WHEN 7 THEN NULL
      ELSE CAST(-3e0 - ((c_custkey * 7919) % 10007) / 10007e0 * 2e0 AS VARCHAR) END AS lat_raw,
    CAST(-38e0 - ((c_custkey * 104729) % 10009) / 10009e0 * 25e-1 AS VARCHAR) AS lon_raw,
    CASE WHEN c_custkey % 20 = 0 THEN 2 ELSE 1 END AS status,
    CASE WHEN c_custkey % 25 = 7 THEN 0 ELSE 1 END AS is_client,
    CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 4 END AS priority_raw,
    CAST(c_custkey % 5 AS INTEGER) AS saturday_priority,
    CASE WHEN c_custkey % 31 <> 0 THEN c_nationkey END AS area_id,
    c_custkey % 97 AS vendor_id,
    CASE WHEN c_custkey % 13 <> 0 THEN c_custkey % 7 END AS supervisor_id
  FROM customer)"""

DRIVERS = """
drivers AS (SELECT s_suppkey AS driver_id, s_name AS driver_name FROM supplier)"""

AREAS = """
areas AS (
  SELECT n_nationkey AS area_id,
    CASE WHEN n_nationkey = 24 THEN n_name
      ELSE lpad(CAST(n_nationkey AS VARCHAR), 3, '0') || ' - '
        || CASE n_nationkey % 3 WHEN 0 THEN 'L81-' WHEN 1 THEN 'L82-' ELSE 'L80-' END || n_name END AS area_desc
  FROM nation)"""

ROSTER = """
roster_lines AS (
  SELECT n_nationkey AS k, 'A' AS week_code, n_name FROM nation WHERE n_nationkey % 3 = 1 AND n_nationkey <> 22
  UNION ALL
  SELECT n_nationkey, 'B', n_name FROM nation
  WHERE n_nationkey % 3 = 1 AND n_nationkey <> 22 AND n_nationkey % 2 = 1),
roster AS (
  SELECT row_number() OVER (ORDER BY week_code, k) AS row_no,
    CASE WHEN k % 5 = 0 THEN '  ' ELSE '' END || 'L82-' || n_name || CASE WHEN k % 4 = 0 THEN ' ' ELSE '' END AS route,
    'DRV_' || CAST((k + CASE WHEN week_code = 'B' THEN k % 2 ELSE 0 END) % 4 AS VARCHAR) AS driver_name
  FROM roster_lines),
roster_map AS (
  SELECT trim(route) AS route, arg_max(driver_name, row_no) AS driver_name FROM roster GROUP BY trim(route))"""

NETWORKS = """
networks AS (
  SELECT CASE WHEN c_custkey % 2 = 0 THEN ' ' ELSE '' END || CAST(c_custkey AS VARCHAR) || ' ' AS customer_id,
    'NET_' || CAST(c_custkey % 9 AS VARCHAR) AS network,
    CASE WHEN c_custkey % 6 <> 0 THEN 'SUB_' || CAST(c_custkey % 4 AS VARCHAR) END AS subnetwork
  FROM customer WHERE c_custkey % 3 = 0
  UNION ALL
  SELECT CASE WHEN c_custkey % 2 = 0 THEN ' ' ELSE '' END || CAST(c_custkey AS VARCHAR) || ' ', 'NET_X', 'SUB_X'
  FROM customer WHERE c_custkey % 33 = 0)"""

# dayofweek counts from Sunday = 0 here.
_DATE = "CAST(d.departure_ts AS DATE)"
_DAYS = {
    "next_day_by_driver": f"{_DATE} = k.as_of + CASE WHEN dayofweek(k.as_of) = 6 THEN 2 ELSE 1 END",
    "six_day_by_date": f"{_DATE} BETWEEN k.as_of AND k.as_of + 5",
    "same_day_by_driver": f"{_DATE} = k.as_of + CASE WHEN dayofweek(k.as_of) = 6 THEN 2 ELSE 0 END",
    "interior_mon_tue": f"{_DATE} IN (k.as_of + CAST(1 - dayofweek(k.as_of) AS INTEGER),"
    " k.as_of + CAST(2 - dayofweek(k.as_of) AS INTEGER))",
    "interior_eight_day_by_roster": f"{_DATE} BETWEEN k.as_of AND k.as_of + 7",
}
_OPS = {
    "next_day_by_driver": CAPITAL_OPS,
    "six_day_by_date": CAPITAL_OPS,
    "same_day_by_driver": CAPITAL_OPS,
    "interior_mon_tue": INTERIOR_WEEK_OPS,
    "interior_eight_day_by_roster": INTERIOR_GENERAL_OPS,
}


def report_ctes(name: str) -> str:
    """CTEs up to ``report``, the rows of a scenario for all days, coordinates not yet rounded."""
    with_driver = name in ("next_day_by_driver", "same_day_by_driver", "interior_mon_tue")
    with_area = name == "interior_eight_day_by_roster"
    weekly = name == "interior_mon_tue"
    group = ["k.as_of", "d.departure_ts", "d.customer_id", "d.op_code", "c.trade_name", "c.lat_raw", "c.lon_raw"]
    ties = ["d.departure_ts", "d.op_code"]
    if not weekly:
        group += ["d.status", "c.priority_raw", "c.saturday_priority"]
        ties += ["d.status"]
    if with_driver:
        group += ["m.driver_name"]
        ties += ["m.driver_name"]
    if with_area:
        group += ["a.area_desc"]
        ties += ["a.area_desc"]
    joins = "JOIN drivers AS m ON m.driver_id = d.driver_id" if with_driver else ""
    joins += "LEFT JOIN areas AS a ON a.area_id = c.area_id" if with_area else ""
    columns = ["as_of", "departure_ts", "customer_id", "op_code", "trade_name"]
    columns += ["TRY_CAST(lat_raw AS DOUBLE) AS lat", "TRY_CAST(lon_raw AS DOUBLE) AS lon"]
    source = "ranked"
    if with_area:
        columns += ["area_desc", "coalesce(r.driver_name, 'SEM ROTA DEFINIDA') AS driver_name"]
        source = """ranked LEFT JOIN roster_map AS r ON r.route =
          CASE WHEN contains(area_desc, ' - ') THEN trim(substr(area_desc, strpos(area_desc, ' - ') + 3)) END"""
    if with_driver:
        columns += ["driver_name"]
    if weekly:
        columns += ["3 AS priority"]
    else:
        columns += ["CAST(coalesce(priority_raw, 3) AS INTEGER) AS priority", "saturday_priority"]
    return f"""{CALENDAR},{DELIVERIES},{CUSTOMERS},{DRIVERS},{AREAS},{ROSTER},
ranked AS (
  SELECT {", ".join(group)},
    sum(coalesce(d.weight_kg, 0)) AS weight_kg, sum(coalesce(d.revenue, 0)) AS revenue,
    row_number() OVER (PARTITION BY k.as_of, d.customer_id ORDER BY {", ".join(ties)}) AS rn
  FROM deliveries AS d
  JOIN customers AS c ON c.customer_id = d.customer_id
  {joins}
  JOIN calendar AS k ON {_DAYS[name]}
  WHERE c.status = 1 AND d.status IN (1, 3) AND d.op_code IN ({_numbers(_OPS[name])})
  GROUP BY {", ".join(group)}),
report AS (SELECT {", ".join(columns)}, weight_kg, revenue FROM {source} WHERE rn = 1)"""


_ROUND_REPORT = (
    "REPLACE (round(lat, 6) AS lat, round(lon, 6) AS lon, round(weight_kg, 2) AS weight_kg, round(revenue, 2) AS revenue)"
)


def report_sql(name: str) -> str:
    return f"WITH {report_ctes(name)} SELECT * {_ROUND_REPORT} FROM report"


def _km(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (
        f"12742e0 * asin(least(1e0, sqrt(pow(sin((radians({lat2}) - radians({lat1})) / 2e0), 2)"
        f" + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2e0), 2))))"
    )


def walk_ctes(keys: list[str], ties: list[str], depot: tuple[float, float]) -> str:
    """CTE ``walk``: the stops of ``stops`` in visit order, found by looking at all that remain."""
    key_list = ", ".join(keys)
    same = " AND ".join(f"w.{k} = s.{k}" for k in keys)
    picked = ", ".join(f"s.{k}" for k in keys)
    return f"""
walk AS (
  SELECT {key_list}, CAST({depot[0]}e0 AS DOUBLE) AS lat, CAST({depot[1]}e0 AS DOUBLE) AS lon,
    CAST(NULL AS DOUBLE) AS prev_lat, CAST(NULL AS DOUBLE) AS prev_lon, CAST(NULL AS DOUBLE) AS leg_km,
    CAST(NULL AS BIGINT) AS customer_id, CAST(NULL AS INTEGER) AS block, 0 AS visit_seq,
    CAST([] AS BIGINT[]) AS visited
  FROM (SELECT DISTINCT {key_list} FROM stops)
  UNION ALL
  SELECT {key_list}, lat, lon, prev_lat, prev_lon, leg_km, customer_id, block, visit_seq,
    list_append(visited, customer_id)
  FROM (
    SELECT {picked}, s.lat, s.lon, w.lat AS prev_lat, w.lon AS prev_lon, s.customer_id, s.block,
      w.visit_seq + 1 AS visit_seq, w.visited, {_km("w.lat", "w.lon", "s.lat", "s.lon")} AS leg_km,
      row_number() OVER (PARTITION BY {picked}
        ORDER BY s.block, {_km("w.lat", "w.lon", "s.lat", "s.lon")}, {", ".join("s." + c for c in ties)}) AS rn
    FROM walk AS w JOIN stops AS s ON {same}
    WHERE NOT list_contains(w.visited, s.customer_id)
  ) WHERE rn = 1)"""


_BLOCK = "CASE priority WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS block"


def scenario_walk(name: str, key: str, depot) -> str:
    return f"""WITH RECURSIVE {report_ctes(name)},
stops AS (SELECT *, {_BLOCK} FROM report WHERE lat IS NOT NULL AND lon IS NOT NULL AND {key} IS NOT NULL),
{walk_ctes(["as_of", key], ["departure_ts", "customer_id"] if key != "departure_ts" else ["customer_id"], depot)}"""


def routes_sql(name: str, key: str, depot) -> str:
    return f"""{scenario_walk(name, key, depot)}
SELECT as_of, {key}, customer_id, block, visit_seq FROM walk WHERE visit_seq > 0"""


def nation_walk(block: str) -> str:
    return f"""WITH RECURSIVE stops AS (
  SELECT c_nationkey AS nation_key, c_custkey AS customer_id,
    -3e0 - ((c_custkey * 7919) % 10007) / 10007e0 * 2e0 AS lat,
    -38e0 - ((c_custkey * 104729) % 10009) / 10009e0 * 25e-1 AS lon,
    {block} AS block
  FROM customer),
{walk_ctes(["nation_key"], ["customer_id"], CITY_DEPOT)}"""


NATION_WALK = nation_walk("CASE WHEN c_custkey % 4 IN (1, 2) THEN CAST(c_custkey % 4 AS INTEGER) ELSE 3 END")
ONE_BLOCK_WALK = nation_walk("3")

NATION_ROUTES = f"""{NATION_WALK}
SELECT nation_key, customer_id, block, visit_seq FROM walk WHERE visit_seq > 0"""

MASTER = f"""{CUSTOMERS},{AREAS},{NETWORKS},
basic AS (
  SELECT CAST(c.customer_id AS VARCHAR) AS customer_id, c.trade_name AS trade_name,
    TRY_CAST(c.lat_raw AS DOUBLE) AS lat, TRY_CAST(c.lon_raw AS DOUBLE) AS lon,
    a.area_desc AS area_desc, c.vendor_id AS vendor_id, v.person_name AS vendor_name,
    coalesce(s.person_name, 'N/A') AS supervisor
  FROM customers AS c
  JOIN areas AS a ON a.area_id = c.area_id
  LEFT JOIN customers AS v ON v.customer_id = c.vendor_id
  LEFT JOIN customers AS s ON s.customer_id = c.supervisor_id
  WHERE c.status = 1 AND c.is_client = 1 AND a.area_desc IS NOT NULL AND a.area_desc NOT IN ({_texts(EXCLUDED)})
    AND TRY_CAST(c.lat_raw AS DOUBLE) BETWEEN -90 AND 90 AND TRY_CAST(c.lon_raw AS DOUBLE) BETWEEN -180 AND 180),
master AS (
  SELECT b.*,
    CASE WHEN upper(area_desc) LIKE '%L81%' THEN 'L81-CAPITAL' WHEN upper(area_desc) LIKE '%L82%' THEN 'L82-INTERIOR'
      ELSE 'OUTROS' END AS region,
    coalesce(trim(n.network), '') AS network, coalesce(trim(n.subnetwork), '') AS subnetwork
  FROM basic AS b LEFT JOIN networks AS n ON trim(n.customer_id) = b.customer_id)"""

_ROUND_PLACE = "REPLACE (round(lat, 6) AS lat, round(lon, 6) AS lon)"

_CHOICES = [
    ("region", "region"), ("area", "area_desc"), ("id", "customer_id"), ("customer", "trade_name"),
    ("vendor", "vendor_name"), ("supervisor", "supervisor"), ("network", "network"), ("subnetwork", "subnetwork"),
]
FACETS = f"""{MASTER},
pairs AS ({" UNION ".join(f"SELECT '{f}' AS facet, {c} AS value FROM master" for f, c in _CHOICES)}),
choices AS (
  SELECT facet, value FROM pairs
  WHERE value IS NOT NULL AND NOT (facet IN ('network', 'subnetwork') AND value IN ('', 'nan'))),
kinds AS (SELECT facet, bool_and(TRY_CAST(value AS HUGEINT) IS NOT NULL) AS is_number FROM choices GROUP BY facet),
facet_values AS (
  SELECT c.facet AS facet, value, CAST(row_number() OVER (
    PARTITION BY c.facet ORDER BY CASE WHEN is_number THEN TRY_CAST(value AS HUGEINT) END, upper(value), value
  ) AS BIGINT) AS position
  FROM choices AS c JOIN kinds AS k ON k.facet = c.facet)"""

SHOWN = f"""{MASTER},
shown AS (
  SELECT * FROM master
  WHERE region IN ({_texts(SELECTION["region"])}) AND supervisor IN ({_texts(SELECTION["supervisor"])}))"""


def hsv(hue: str, saturation: float, value: float, rounded: bool = False) -> str:
    flat = f"{value!r}e0 * (1e0 - {saturation!r}e0)"
    part = f"(({hue}) * 6e0 - floor(({hue}) * 6e0))"
    falling = f"{value!r}e0 * (1e0 - {part} * {saturation!r}e0)"
    rising = f"{value!r}e0 * (1e0 - (1e0 - {part}) * {saturation!r}e0)"
    full = f"{value!r}e0"
    sectors = [
        (full, rising, flat), (falling, full, flat), (flat, full, rising),
        (flat, falling, full), (rising, flat, full), (full, flat, falling),
    ]
    shift = " + 0.5e0" if rounded else ""

    def channel(i: int) -> str:
        cases = " ".join(f"WHEN {n} THEN {sectors[n][i]}" for n in range(6))
        number = f"(CASE CAST(floor(({hue}) * 6e0) AS INTEGER) % 6 {cases} END) * 255e0{shift}"
        return f"lpad(lower(to_hex(CAST(floor({number}) AS INTEGER))), 2, '0')"

    return f"'#' || {channel(0)} || {channel(1)} || {channel(2)}"


def palette(names: str, order: str, rounded: bool) -> str:
    """Palette over the relation ``names(name)``."""
    hue = "CAST(position AS DOUBLE) / CAST(total AS DOUBLE)"
    return f"""
    SELECT name, CAST(position AS BIGINT) AS position, {hsv(hue, 0.75, 0.9, rounded)} AS color
    FROM (SELECT name, row_number() OVER (ORDER BY {order}) - 1 AS position, count(*) OVER () AS total FROM ({names}))"""


_SUPERVISORS = palette("SELECT DISTINCT supervisor AS name FROM master", "upper(name), name", False)
_ONE = f"SELECT * FROM master WHERE supervisor IN ({_texts(ONE_SUPERVISOR['supervisor'])})"
_VENDORS = palette(
    f"SELECT DISTINCT vendor_name AS name FROM ({_ONE}) WHERE coalesce(vendor_name, '') <> ''", "name", True
)


def money(value: str) -> str:
    return f"'R$ ' || translate(format('{{:,.2f}}', CAST({value} AS DOUBLE)), ',.', '.,')"


_COLOR_LIST = "[" + _texts(ROUTE_COLORS) + "]"


def legend_sql(name: str) -> str:
    by_time = name == "six_day_by_date"
    key = "departure_ts" if by_time else "driver_name"
    shown_date = {
        "next_day_by_driver": "strftime(as_of + CASE WHEN dayofweek(as_of) = 6 THEN 2 ELSE 1 END, '%d/%m/%Y')",
        "six_day_by_date": "strftime(as_of, '%d/%m/%Y')",
    }.get(name, "'-'")
    entry = "strftime(entry_key, '%d/%m/%Y')" if by_time else "upper(entry_key)"
    revenue = "CAST(NULL AS DOUBLE)" if by_time else "round(entry_revenue, 2)"
    text = "CAST(NULL AS VARCHAR)" if by_time else money("entry_revenue")
    return f"""WITH {report_ctes(name)},
totals AS (
  SELECT as_of, count(DISTINCT customer_id) AS total_customers, sum(revenue) AS total_revenue FROM report GROUP BY as_of),
entries AS (
  SELECT as_of, {key} AS entry_key, min(departure_ts) AS first_departure, sum(revenue) AS entry_revenue
  FROM report WHERE {key} IS NOT NULL GROUP BY as_of, {key}),
numbered AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY as_of ORDER BY first_departure, entry_key) - 1 AS BIGINT) AS position
  FROM entries)
SELECT t.as_of AS as_of, total_customers, round(total_revenue, 2) AS total_revenue,
  {money("total_revenue")} AS total_text, {shown_date.replace("as_of", "t.as_of")} AS legend_date, position,
  {entry} AS entry, {_COLOR_LIST}[position % {len(ROUTE_COLORS)} + 1] AS color,
  {revenue} AS entry_revenue, {text} AS entry_text
FROM totals AS t LEFT JOIN numbered AS n ON n.as_of = t.as_of"""


def select_all_sql(facet: str, column: str) -> str:
    return f"""WITH {FACETS}
SELECT * {_ROUND_PLACE} FROM master
WHERE coalesce({column}, '') IN (SELECT value FROM facet_values WHERE facet = '{facet}')"""


_PRIORITY_TEXT = (
    "CASE priority " + " ".join(f"WHEN {n} THEN '{label}'" for n, label in PRIORITY_LABELS.items())
    + f" ELSE '{DAYTIME_LABEL}' END"
)
_SAME_DAY = report_ctes("same_day_by_driver")

NETWORK_LINES = f"""WITH {NETWORKS}
SELECT CAST(c_custkey AS VARCHAR) AS customer_id, coalesce(trim(network), '') AS network,
  coalesce(trim(subnetwork), '') AS subnetwork
FROM customer LEFT JOIN networks ON trim(customer_id) = CAST(c_custkey AS VARCHAR)"""

ORACLE = {
    **{name: report_sql(name) for name in _DAYS},
    "scenario_totals": f"""WITH {_SAME_DAY}
SELECT as_of, count(DISTINCT customer_id) AS customers, round(sum(revenue), 2) AS revenue FROM report GROUP BY as_of""",
    "driver_totals": f"""WITH {report_ctes("interior_eight_day_by_roster")}
SELECT as_of, driver_name, round(sum(revenue), 2) AS revenue FROM report GROUP BY as_of, driver_name""",
    "scenario_legend": legend_sql("next_day_by_driver"),
    "date_legend": legend_sql("six_day_by_date"),
    "roster_legend": legend_sql("interior_eight_day_by_roster"),
    "route_palette": f"""WITH {report_ctes("next_day_by_driver")},
firsts AS (SELECT as_of, driver_name, min(departure_ts) AS first_departure FROM report GROUP BY as_of, driver_name),
numbered AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY as_of ORDER BY first_departure, driver_name) - 1 AS BIGINT) AS position
  FROM firsts)
SELECT *, {_COLOR_LIST}[position % {len(ROUTE_COLORS)} + 1] AS color FROM numbered""",
    "date_palette": f"""WITH {report_ctes("six_day_by_date")},
numbered AS (
  SELECT as_of, departure_ts,
    CAST(row_number() OVER (PARTITION BY as_of ORDER BY departure_ts) - 1 AS BIGINT) AS position
  FROM (SELECT DISTINCT as_of, departure_ts FROM report))
SELECT *, {_COLOR_LIST}[position % {len(ROUTE_COLORS)} + 1] AS color FROM numbered""",
    "bounding_boxes": f"""WITH {report_ctes("six_day_by_date")}
SELECT as_of, round(least(min(lat), {CITY_DEPOT[0]}e0), 6) AS min_lat, round(least(min(lon), {CITY_DEPOT[1]}e0), 6) AS min_lon,
  round(greatest(max(lat), {CITY_DEPOT[0]}e0), 6) AS max_lat, round(greatest(max(lon), {CITY_DEPOT[1]}e0), 6) AS max_lon
FROM report WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY as_of""",
    "coordinate_cleaning": f"""WITH {CUSTOMERS},
cleaned AS (
  SELECT customer_id, TRY_CAST(lat_raw AS DOUBLE) AS lat, TRY_CAST(lon_raw AS DOUBLE) AS lon,
    CAST(coalesce(priority_raw, 3) AS INTEGER) AS priority
  FROM customers)
SELECT * {_ROUND_PLACE} FROM cleaned WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180""",
    "distance_from_depot": f"""WITH {CUSTOMERS},
cleaned AS (
  SELECT customer_id, round(TRY_CAST(lat_raw AS DOUBLE), 6) AS lat, round(TRY_CAST(lon_raw AS DOUBLE), 6) AS lon
  FROM customers)
SELECT customer_id, round({_km(f"{CITY_DEPOT[0]}e0", f"{CITY_DEPOT[1]}e0", "lat", "lon")}, 6) AS distance_km
FROM cleaned WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180""",
    "routes_by_driver": routes_sql("same_day_by_driver", "driver_name", CITY_DEPOT),
    "routes_by_date": routes_sql("six_day_by_date", "departure_ts", CITY_DEPOT),
    "routes_mon_tue": routes_sql("interior_mon_tue", "driver_name", INTERIOR_DEPOT),
    "customer_routes_by_nation": NATION_ROUTES,
    "customer_routes_in_rounds": NATION_ROUTES,
    "nearest_sequence": f"""{ONE_BLOCK_WALK}
SELECT nation_key, customer_id,
  CAST(CASE WHEN customer_id % 4 = 0 THEN 3 ELSE customer_id % 4 END AS INTEGER) AS priority, visit_seq
FROM walk WHERE visit_seq > 0""",
    "route_ends": f"""{ONE_BLOCK_WALK}
SELECT nation_key, round(arg_max(lat, visit_seq), 6) AS lat, round(arg_max(lon, visit_seq), 6) AS lon
FROM walk WHERE visit_seq > 0 GROUP BY nation_key""",
    "route_legs": f"""{NATION_WALK}
SELECT nation_key, visit_seq, customer_id, round(prev_lat, 6) AS prev_lat, round(prev_lon, 6) AS prev_lon,
  round(lat, 6) AS lat, round(lon, 6) AS lon, round(leg_km, 6) AS leg_km
FROM walk WHERE visit_seq > 0""",
    "route_lengths": f"""{scenario_walk("same_day_by_driver", "driver_name", CITY_DEPOT)}
SELECT as_of, driver_name, count(*) AS stops, round(sum(leg_km), 6) AS length_km
FROM walk WHERE visit_seq > 0 GROUP BY as_of, driver_name""",
    "route_path_points": f"""{NATION_WALK}
SELECT nation_key, visit_seq, round(lat, 6) AS lat, round(lon, 6) AS lon FROM walk""",
    "stop_details": f"""{scenario_walk("interior_eight_day_by_roster", "driver_name", INTERIOR_DEPOT)}
SELECT w.as_of AS as_of, w.visit_seq AS visit_seq, w.customer_id AS customer_id,
  coalesce(trade_name, '') AS customer_text, CAST(op_code AS VARCHAR) AS op_text, w.driver_name AS driver_text,
  {_PRIORITY_TEXT} AS priority_text,
  format('{{:,.2f}}', CAST(weight_kg AS DOUBLE)) || ' kg' AS weight_text, {money("revenue")} AS revenue_text,
  strftime(departure_ts, '%d/%m/%Y') AS departure_text, coalesce(area_desc, '') AS route_text
FROM walk AS w JOIN stops AS s
  ON s.as_of = w.as_of AND s.driver_name = w.driver_name AND s.customer_id = w.customer_id""",
    "customer_master": f"WITH {MASTER} SELECT * {_ROUND_PLACE} FROM master",
    "customer_master_basic": f"WITH {MASTER} SELECT * {_ROUND_PLACE} FROM basic",
    "customer_networks": NETWORK_LINES,
    "networks_from_file": NETWORK_LINES,
    "region_counts": f"WITH {MASTER} SELECT region, count(*) AS markers FROM master GROUP BY region",
    "master_summary": f"WITH {MASTER} SELECT count(*) AS markers FROM master",
    "centroid": f"WITH {MASTER} SELECT round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM master",
    "facet_values": f"WITH {FACETS} SELECT * FROM facet_values",
    "facet_values_in_runs": f"WITH {FACETS} SELECT * FROM facet_values",
    "facet_search": f"""WITH {FACETS}
SELECT * FROM facet_values WHERE facet = 'area' AND contains(lower(value), 'l82-nation_1')""",
    "facet_filter": f"WITH {SHOWN} SELECT * {_ROUND_PLACE} FROM shown",
    "facet_filter_summary": f"""WITH {SHOWN}
SELECT count(*) AS customers, count(DISTINCT nullif(vendor_name, '')) AS vendors FROM shown""",
    "facet_summaries": f"""WITH {MASTER},
pairs AS (SELECT DISTINCT supervisor FROM master),
regions AS (SELECT unnest(['L81-CAPITAL', 'L82-INTERIOR']) AS region)
SELECT pairs.supervisor || ' / ' || regions.region AS selection, count(m.customer_id) AS customers,
  count(DISTINCT nullif(m.vendor_name, '')) AS vendors
FROM pairs CROSS JOIN regions LEFT JOIN master AS m
  ON m.supervisor = pairs.supervisor AND m.region = regions.region AND coalesce(m.network, '') IN ('', 'NET_3')
GROUP BY ALL
UNION ALL
SELECT 'everything', count(*), count(DISTINCT nullif(vendor_name, '')) FROM master""",
    "facet_search_indexed": f"""WITH {FACETS},
searches AS (SELECT * FROM (VALUES {", ".join(str(s) for s in SEARCHES)}) AS s (facet, term))
SELECT v.facet, v.value, v.position, s.term FROM facet_values AS v JOIN searches AS s
ON s.facet = v.facet AND contains(lower(v.value), s.term)""",
    "facet_select_all": select_all_sql("vendor", "vendor_name"),
    "facet_select_all_networks": select_all_sql("network", "network"),
    "visible_vendors": f"WITH {SHOWN} SELECT DISTINCT vendor_name FROM shown WHERE coalesce(vendor_name, '') <> ''",
    "supervisor_palette": f"WITH {MASTER} {_SUPERVISORS}",
    "vendor_palette": f"WITH {MASTER} {_VENDORS}",
    "master_legend": f"WITH {MASTER} {_VENDORS}",
    "hash_colors": f"""
SELECT DISTINCT c_name AS name,
  {hsv("CAST(CAST('0x' || substr(md5(lower(trim(c_name))), 1, 6) AS INTEGER) AS DOUBLE) / 16777215e0", 0.65, 0.95)} AS color
FROM customer""",
    "colored_markers": f"""WITH {MASTER}
SELECT m.* {_ROUND_PLACE}, coalesce(p.color, '#999') AS color
FROM ({_ONE}) AS m LEFT JOIN ({_VENDORS}) AS p ON p.name = m.vendor_name""",
    "customer_markers": f"""WITH {MASTER}
SELECT round(lat, 6) AS lat, round(lon, 6) AS lon, {", ".join(c for _, c in _CHOICES)}, p.color AS color
FROM master AS m JOIN ({_SUPERVISORS}) AS p ON p.name = m.supervisor""",
    "palette_json": f"""WITH {MASTER}, palette AS ({_SUPERVISORS})
SELECT CAST(position // 1000 AS INTEGER) AS part,
  '{{' || string_agg('"' || name || '":"' || color || '"', ',' ORDER BY position) || '}}' AS color_map,
  '[' || string_agg('{{"name":"' || name || '","color":"' || color || '"}}', ',' ORDER BY position) || ']' AS color_list
FROM palette GROUP BY position // 1000""",
    "roster_lookup": f"""WITH {CUSTOMERS},{AREAS},{ROSTER}
SELECT c.customer_id, a.area_desc, coalesce(r.driver_name, 'SEM ROTA DEFINIDA') AS driver_name
FROM customers AS c
LEFT JOIN areas AS a ON a.area_id = c.area_id
LEFT JOIN roster_map AS r ON r.route =
  CASE WHEN contains(area_desc, ' - ') THEN trim(substr(area_desc, strpos(area_desc, ' - ') + 3)) END""",
    "roster_from_file": report_sql("interior_eight_day_by_roster"),
    "scattered_days": f"{report_sql('six_day_by_date')} WHERE day(as_of) = 15",
    "scenario_without_roster": f"""WITH {report_ctes("interior_eight_day_by_roster")}
SELECT * {_ROUND_REPORT[:-1]}, 'SEM ROTA DEFINIDA' AS driver_name) FROM report""",
    "tables_from_parquet": report_sql("same_day_by_driver"),
    "written_report": f"WITH {_SAME_DAY} SELECT 'same_day_by_driver' AS scenario, * {_ROUND_REPORT} FROM report",
    "stream_refresh": report_sql("same_day_by_driver"),
}
