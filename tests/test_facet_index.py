"""Facet indexes against filters of the whole master."""

import random

import pytest
from pyspark.sql import functions as F

from stopwise.operators.facet_index import build_facet_index, build_value_index, facet_summaries, indexed_search
from stopwise.operators.facets import facet_filter, facet_filter_summary, facet_search, facet_values

COLUMNS = "region string, area_desc string, customer_id string, trade_name string, vendor_name string, supervisor string, network string, subnetwork string"


def some_master(spark, size):
    draw = random.Random(9)
    rows = [
        (
            f"R{draw.randrange(3)}",
            f"00{draw.randrange(7)} - L8{draw.randrange(3)}",
            str(i // 2),
            f"Shop {i // 2}",
            draw.choice([None, "", "Ana", "Bob", "Cy", f"V{i % 50}"]),
            draw.choice(["S1", "S2", "N/A"]),
            draw.choice(["", "nan", None, "N1", "N2"]),
            None,
        )
        for i in range(size)
    ]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.mark.parametrize("dense", [1, 40, 10**9])
def test_summaries_equal_filters_of_the_master(spark, dense):
    master = some_master(spark, 400).cache()
    selections = {
        "one": {"region": ["R1"], "supervisor": ["S1", "N/A"]},
        "many": {"vendor": ["Ana", "V3", "V4", ""], "area": ["001 - L81", "002 - L80", "004 - L82"], "region": ["R0", "R2"]},
        "ids": {"id": ["3", "77", "1000"]},
        "blank": {"network": [""], "subnetwork": [""]},
        "nobody": {"region": ["R1"], "customer": ["no such shop"]},
        "unknown": {"area": ["elsewhere"]},
    }
    rows = [(name, f, v) for name, chosen in selections.items() for f, values in chosen.items() for v in values]
    rows += [("all", None, None), ("one", "region", "R1")]  # twice
    frame = spark.createDataFrame(rows, "selection string, facet string, value string")
    found = {r.selection: (r.customers, r.vendors) for r in facet_summaries(build_facet_index(master, dense), frame).collect()}
    expected = {
        name: tuple(facet_filter_summary(facet_filter(master, chosen)).first())
        for name, chosen in {**selections, "all": {}}.items()
    }
    assert found == expected and found["nobody"] == (0, 0) and found["one"][0] > 0


def test_places_beyond_one_bucket(spark):
    """70,000 customers lie in three buckets of bits; the master is not read again."""
    master = spark.range(70_000).select(
        F.concat(F.lit("R"), F.col("id") % 3).alias("region"),
        F.concat(F.lit("A"), F.col("id") % 11).alias("area_desc"),
        F.col("id").cast("string").alias("customer_id"),
        F.lit("x").alias("trade_name"),
        F.concat(F.lit("V"), F.col("id") % 700).alias("vendor_name"),
        F.lit("S").alias("supervisor"),
    )
    index = build_facet_index(master)
    frame = spark.createDataFrame(
        [("a", "region", "R1"), ("a", "area", "A3"), ("b", "vendor", "V5"), ("b", "vendor", "V6"), ("c", "id", "69999")],
        "selection string, facet string, value string",
    )
    counts = facet_summaries(index, frame)
    assert "Range" not in counts._jdf.queryExecution().executedPlan().toString()
    found = {r.selection: (r.customers, r.vendors) for r in counts.collect()}
    ids = [i for i in range(70_000) if i % 3 == 1 and i % 11 == 3]
    assert found == {"a": (len(ids), len({i % 700 for i in ids})), "b": (200, 2), "c": (1, 1)}
    assert index.bitmaps.agg(F.max("bucket")).first()[0] == 3


def test_indexed_search_equals_the_search(spark):
    master = some_master(spark, 300)
    odd = spark.createDataFrame([("x", "ÀB çd İstanbul", "1", "a%b_c\\d", "vv", "s", "n", "")], COLUMNS)
    values = facet_values(master.unionByName(odd), 1000).cache()
    index = build_value_index(values)
    for facet, term in [
        ("customer", "shop 1"), ("customer", "SHOP 14"), ("customer", "zzz"), ("area", "l81"), ("area", "001 - l81"),
        ("area", "çd i"), ("customer", "%b_"), ("customer", "\\d"), ("vendor", "V"), ("id", ""), ("id", "123"), ("none", "abc"),
    ]:
        found = sorted(map(tuple, indexed_search(index, facet, term).collect()))
        assert found == sorted(map(tuple, facet_search(values, facet, term).collect())), (facet, term)
    plan = indexed_search(index, "customer", "shop 14")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "EqualTo(piece," in plan
