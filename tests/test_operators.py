"""Numbering, roster, networks, facets and palettes."""

import random

import pytest
from pyspark.sql import functions as F

from stopwise.operators import facets, palettes
from stopwise.operators.numbering import number_within
from stopwise.operators.roster import assign_roster, enrich_networks, roster_lookup
from stopwise.sources.tables import from_source_names, load_tables, read_networks, read_roster


@pytest.mark.parametrize("limit", [10, 1_000_000])
def test_numbers_within_groups_however_large(spark, limit):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.6 else f"g{i % 9}", i) for i in range(2000)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "g string, v int").repartition(5)
    numbered = number_within(frame, ["g"], [F.col("v")], "n", rows_per_group=2000, limit=limit, size_out="size")
    groups = {}
    for g, v in sorted(rows):
        groups.setdefault(g, []).append(v)
    expected = {(g, v, n + 1, len(vs)) for g, vs in groups.items() for n, v in enumerate(vs)}
    assert {tuple(r) for r in numbered.select("g", "v", "n", "size").collect()} == expected


def test_an_unknown_bound_is_taken_as_too_large(spark):
    frame = spark.createDataFrame([("a", i) for i in range(20)], "g string, v int")
    numbered = number_within(frame, ["g"], [F.col("v").desc()], "n")
    assert all(r.n == 20 - r.v for r in numbered.collect())


ROSTER = [
    ("1", "10", " L82-A ", " DRV_1 ", "A"),
    ("2", "11", "L82-B", "DRV_2", "A"),
    ("1", "10", "L82-A", "DRV_9", "B"),
    ("3", "12", "L82-C", None, "B"),
]


def write_roster(path):
    lines = ["A14_ID;COD ROTA;ROTA;MOTORISTA;SEMANA", *(";".join(v or "" for v in r) for r in ROSTER)]
    path.write_bytes(b"\xef\xbb\xbf" + "\n".join(lines).encode())
    return str(path)


def test_roster_file_and_last_line_wins(spark, tmp_path):
    roster = read_roster(spark, write_roster(tmp_path / "roster.csv"))
    assert roster.columns == ["area_id", "route_code", "route", "driver_name", "week_code", "row_no"]
    assert {r.route: r.driver_name for r in roster_lookup(roster).collect()} == {
        "L82-A": "DRV_9", "L82-B": "DRV_2", "L82-C": None,
    }


def test_roster_assignment(spark, tmp_path):
    roster = read_roster(spark, write_roster(tmp_path / "roster.csv"))
    areas = ["7 - L82-A ", "8 - L82-B", "9 - L82-C", "5 - L82-Z", "NOSEP", None]
    frame = spark.createDataFrame(list(enumerate(areas)), "i int, area_desc string")
    got = [r.driver_name for r in assign_roster(frame, roster).orderBy("i").collect()]
    fallback = "SEM ROTA DEFINIDA"
    assert got == ["DRV_9", "DRV_2", fallback, fallback, fallback, fallback]
    assert {r.driver_name for r in assign_roster(frame, None).collect()} == {fallback}


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_networks_multiply_rows(spark, tmp_path, limit):
    path = tmp_path / "networks.csv"
    path.write_text("X,SUBREDE,A00_ID,REDE\n1,s1, 5 ,n1\n1,,5,n2\n1,s3,6,\n1,s4,,n4\n")
    networks = read_networks(spark, str(path))
    frame = spark.createDataFrame([(5,), (6,), (7,)], "customer_id long")
    got = sorted(map(tuple, enrich_networks(frame, networks, limit).collect()))
    assert got == [("5", "n1", "s1"), ("5", "n2", ""), ("6", "", "s3"), ("7", "", "")]
    assert {tuple(r) for r in enrich_networks(frame, None).collect()} == {("5", "", ""), ("6", "", ""), ("7", "", "")}


MASTER = [
    ("1", "Alfa", "a", "R1", "v1", "s1", "n1", ""),
    ("2", "beta", "b", "R1", "v2", "s1", "", ""),
    ("10", "Gama", "c", "R2", None, "s2", "nan", ""),
    ("11", None, "c", "R2", "v3", "N/A", "n2", ""),
]
MASTER_COLUMNS = (
    "customer_id string, trade_name string, area_desc string, region string, vendor_name string,"
    " supervisor string, network string, subnetwork string"
)


@pytest.fixture()
def master(spark):
    return spark.createDataFrame(MASTER, MASTER_COLUMNS).withColumns({"lat": F.lit(-3.5), "lon": F.lit(-38.5)})


@pytest.mark.parametrize("bound", [100, None])
def test_facet_values_sort_by_number_or_text(spark, master, bound):
    lists = {}
    for r in facets.facet_values(master, bound).orderBy("facet", "position").collect():
        lists.setdefault(r.facet, []).append(r.value)
    assert lists == {
        "id": ["1", "2", "10", "11"],
        "customer": ["Alfa", "beta", "Gama"],
        "area": ["a", "b", "c"],
        "region": ["R1", "R2"],
        "vendor": ["v1", "v2", "v3"],
        "supervisor": ["N/A", "s1", "s2"],
        "network": ["n1", "n2"],
    }


def ids(df):
    return sorted(int(r.customer_id) for r in df.select("customer_id").collect())


def test_facet_filter(spark, master):
    assert ids(facets.facet_filter(master, {})) == [1, 2, 10, 11]
    assert ids(facets.facet_filter(master, {"region": []})) == [1, 2, 10, 11]
    assert ids(facets.facet_filter(master, {"region": ["R1", "R2"], "vendor": ["v1", "v3"]})) == [1, 11]
    assert ids(facets.facet_filter(master, {"vendor": [""]})) == [10]
    chosen = spark.createDataFrame([("1",), ("11",), ("1",)], "value string")
    assert ids(facets.facet_filter(master, {"id": chosen, "region": ["R2"]})) == [11]


def test_select_all_drops_missing_attributes(spark, master):
    values = facets.facet_values(master, 100)
    for facet in facets.FACETS:
        chosen = values.where(F.col("facet") == facet)
        if chosen.isEmpty():
            continue
        assert ids(facets.facet_select_all(master, facet)) == ids(facets.facet_filter(master, {facet: chosen}))
    assert ids(facets.facet_select_all(master, "vendor")) == [1, 2, 11]
    assert ids(facets.facet_select_all(master, "network")) == [1, 11]
    blank = master.withColumn("vendor_name", F.when(F.col("customer_id") == "1", "").otherwise(F.col("vendor_name")))
    assert ids(facets.facet_select_all(blank, "vendor")) == [1, 2, 10, 11]


def test_search_and_summary(spark, master):
    values = facets.facet_values(master, 100)
    assert {r.value for r in facets.facet_search(values, "customer", "A").collect()} == {"Alfa", "beta", "Gama"}
    assert {r.value for r in facets.facet_search(values, "customer", "ET").collect()} == {"beta"}
    assert tuple(facets.facet_filter_summary(master).first()) == (4, 3)


@pytest.mark.parametrize("bound", [100, None])
def test_colors_follow_the_selection(spark, master, bound):
    by_supervisor = {r.name: r.color for r in palettes.master_legend(master, {}, bound).collect()}
    assert list(sorted(by_supervisor)) == ["N/A", "s1", "s2"]
    everyone = palettes.colored_master(master, {}, bound).collect()
    assert all(r.color == by_supervisor[r.supervisor] for r in everyone)

    one = {"supervisor": ["s1"]}
    by_vendor = {r.name: r.color for r in palettes.master_legend(master, one, bound).collect()}
    assert sorted(by_vendor) == ["v1", "v2"]
    assert {r.color for r in palettes.colored_master(master, one, bound).collect()} == set(by_vendor.values())
    missing = palettes.colored_master(master, {"supervisor": ["s2"]}, bound).first()
    assert missing.color == "#999"


def test_palette_texts(spark, master):
    palette = palettes.supervisor_palette(master, 100)
    whole = palettes.palette_json(palette).collect()
    assert len(whole) == 1 and whole[0].color_map.startswith('{"N/A":"#')
    parts = palettes.palette_json(palette, entries=2).orderBy("part").collect()
    assert [len(eval(p.color_list)) for p in parts] == [2, 1]


def test_quotes_in_names_stay_valid_json(spark):
    import json

    palette = spark.createDataFrame([('a"b', 0, "#000000")], "name string, position long, color string")
    assert json.loads(palettes.palette_json(palette).first().color_map) == {'a"b': "#000000"}


def test_tables_are_read_with_declared_types(spark, tmp_path):
    source = spark.createDataFrame([(1, "D1")], "M13_ID int, M13_DESC string")
    from_source_names("drivers", source).write.parquet(str(tmp_path / "drivers"))
    loaded = load_tables(spark, str(tmp_path), ["drivers"])["drivers"]
    assert loaded.schema.simpleString() == "struct<driver_id:bigint,driver_name:string>"
    assert tuple(loaded.first()) == (1, "D1")


def test_unreadable_values_are_null_and_missing_columns_an_error(spark):
    columns = "M06_ID string, M06_ID_CLIENTE long, M06_ID_A76 int, M06_STATUS int, M06_ID_M13 long, M06_DTSAIDA string"
    source = spark.createDataFrame([("x", 1, 38, 1, 1, "no day", 2.0)], f"{columns}, M06_VOL_PESOL double")
    with pytest.raises(ValueError, match="M06_TOTPRO"):
        from_source_names("deliveries", source)
    read = from_source_names("deliveries", source.withColumn("M06_TOTPRO", F.lit("3.5"))).first()
    assert (read.delivery_id, read.departure_ts, read.revenue) == (None, None, 3.5)


def test_roster_columns_are_found_by_name(spark, tmp_path):
    path = tmp_path / "roster.csv"
    path.write_bytes(b"\xef\xbb\xbfMOTORISTA;SEMANA;ROTA;A14_ID;COD ROTA\nDRV_1;A;L82-A;1;10\nDRV_9;B;L82-A;1;10\n")
    found = read_roster(spark, str(path))
    assert [tuple(r) for r in roster_lookup(found).collect()] == [("L82-A", "DRV_9")]


def test_null_groups_are_numbered_on_both_branches(spark):
    frame = spark.createDataFrame([(None, 3), (None, 1), ("a", 2), ("a", 5), (None, 2)], "g string, v int")
    found = [
        sorted(map(tuple, number_within(frame, ["g"], [F.col("v")], "n", rows_per_group=5, limit=limit).collect()), key=str)
        for limit in (10, 1)
    ]
    assert found[0] == found[1] and len(found[0]) == 5
