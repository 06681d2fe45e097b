"""Column functions on small literal tables."""

import colorsys
import hashlib
import math
import random
from datetime import date, datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stopwise.functions import colors, dates, display, geo, text


def apply(spark, values, type_name, function):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_name}")
    return [r.out for r in frame.select("i", function(F.col("v")).alias("out")).orderBy("i").collect()]


def test_numbers_are_parsed_like_pandas_does(spark):
    texts = [
        "n/a", "95.5", None, "", "1d", "1e2", " -3.7 ", "-3,7", "NaN", "inf", "-Infinity", "+5", ".5", "5.", "1e",
        "0x10", "\t4\n", "True", "1_000", "1e400", "--1", "1 2", "1E+2", "None",
    ]
    expected = pd.to_numeric(pd.Series(texts, dtype=object), errors="coerce").tolist()
    for got, want in zip(apply(spark, texts, "string", text.to_number), expected, strict=True):
        assert got == want or (got is None and math.isnan(want))


def test_text_is_stripped_like_python_does(spark):
    texts = ["  a b ", "\ta\n", " x　", "\x1cq\x1f", "", None]
    assert apply(spark, texts, "string", text.strip) == [t if t is None else t.strip() for t in texts]


def test_route_text(spark):
    areas = ["181 - L82-X", "700 - L81 - Y", "NOSEP", None, "1 - \tA B \n", " - z", "9 - "]
    expected = ["L82-X", "L81 - Y", None, None, "A B", "z", ""]
    assert apply(spark, areas, "string", text.clean_route) == expected


def test_region(spark):
    areas = ["1 - L81-A", "1 - l82-B", "L82 and L81", "L80", ""]
    assert apply(spark, areas, "string", text.region) == ["L81-CAPITAL", "L82-INTERIOR", "L81-CAPITAL", "OUTROS", "OUTROS"]


def test_priority_and_block(spark):
    values = [None, "1", "2", "3", "9", "2.9", "x", "inf"]
    assert apply(spark, values, "string", text.priority) == [3, 1, 2, 3, 9, 2, 3, 3]
    assert apply(spark, [1, 2, 3, 0, None], "int", text.priority_block) == [1, 2, 3, 3, 3]
    labels = apply(spark, [1, 2, 3, 9], "int", display.priority_label)
    assert labels == ["☀️ MANHÃ", "⚡ ATÉ 16h", "🕒 DIURNO", "🕒 DIURNO"]


def test_timestamps(spark):
    parsed = apply(spark, ["2024-06-01 10:00:00", "x", None], "string", text.to_ts)
    assert parsed == [datetime(2024, 6, 1, 10), None, None]


DAYS = [date(2024, 6, 1), date(2024, 6, 2), date(2024, 6, 3), date(2024, 5, 31), date(2024, 12, 28)]


def test_reference_dates(spark):
    following = apply(spark, DAYS, "date", lambda c: dates.reference_date(c, 1))
    assert following == [date(2024, 6, 3), date(2024, 6, 3), date(2024, 6, 4), date(2024, 6, 1), date(2024, 12, 30)]
    same = apply(spark, DAYS, "date", lambda c: dates.reference_date(c, 0))
    assert same == [date(2024, 6, 3), date(2024, 6, 2), date(2024, 6, 3), date(2024, 5, 31), date(2024, 12, 30)]


def test_monday_and_tuesday_of_a_sunday_are_the_next_days(spark):
    pairs = apply(spark, DAYS, "date", dates.week_mon_tue)
    assert pairs[0] == [date(2024, 5, 27), date(2024, 5, 28)]
    assert pairs[1] == pairs[2] == [date(2024, 6, 3), date(2024, 6, 4)]
    assert pairs[4] == [date(2024, 12, 23), date(2024, 12, 24)]


def test_distance(spark):
    rows = [(-3.75, -38.58, -3.81, -39.25), (0.0, 0.0, 0.0, 180.0), (10.0, 10.0, 10.0, 10.0)]
    frame = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = [r[0] for r in frame.select(geo.haversine_km(*map(F.col, "abcd"))).collect()]
    assert got == pytest.approx([74.68, 6371 * math.pi, 0.0], abs=0.1)


def test_places_on_the_globe(spark):
    rows = [(1.0, 2.0), (95.5, 0.0), (float("nan"), 0.0), (float("inf"), 0.0), (None, 0.0), (-90.0, 180.0)]
    frame = spark.createDataFrame(rows, "lat double, lon double")
    assert frame.where(geo.in_range(F.col("lat"), F.col("lon"))).count() == 2
    assert frame.where(geo.is_point(F.col("lat"), F.col("lon"))).count() == 3


def test_two_decimals_are_those_of_the_exact_binary_value(spark):
    rng = random.Random(7)
    values = [0.0, 1234567.5, -1234.5, 0.125, 0.375, 2.675, 1.005, -0.001, 1e12, 1e15, 0.005, 0.015, -2.675]
    values += [rng.choice([-1, 1]) * round(rng.random() * 10 ** rng.randint(0, 9), rng.randint(0, 4)) for _ in range(3000)]
    values += [k / 8 for k in range(-200, 200)] + [k / 1000 for k in range(0, 20000, 5)]
    values = [v + 0.0 for v in values]  # no negative zero, which no sum of ours gives
    assert apply(spark, values, "double", display.two_decimals) == [f"{v:,.2f}" for v in values]


def test_money_weight_and_date_texts(spark):
    assert apply(spark, [0.0, 1234567.5, -1234.5, None, 0.125], "double", display.format_currency) == [
        "R$ 0,00", "R$ 1.234.567,50", "R$ -1.234,50", "R$ 0,00", "R$ 0,12",
    ]
    assert apply(spark, [1234.5, None], "double", display.format_weight) == ["1,234.50 kg", "0.00 kg"]
    assert apply(spark, [date(2024, 6, 1), None], "date", display.format_date) == ["01/06/2024", "-"]


def hex_of(hue, saturation, value, rounded):
    channels = colorsys.hsv_to_rgb(hue, saturation, value)
    return "#" + "".join(f"{math.floor(c * 255 + 0.5) if rounded else int(c * 255):02x}" for c in channels)


@pytest.mark.parametrize("rounded", [False, True])
def test_evenly_spaced_colors(spark, rounded):
    pairs = [(i, n) for n in range(1, 61) for i in range(n)]
    frame = spark.createDataFrame(pairs, "i int, n int")
    got = frame.select("i", "n", colors.palette_color(F.col("i"), F.col("n"), rounded).alias("color")).collect()
    assert all(r.color == hex_of(r.i / r.n, 0.75, 0.9, rounded) for r in got)


def test_colors_by_name(spark):
    names = ["Ana", " ana ", None, "", "Zé"]
    keys = [(n or "N/A").strip().lower() for n in names]
    expected = [hex_of(int(hashlib.md5(k.encode()).hexdigest()[:6], 16) / 0xFFFFFF, 0.65, 0.95, False) for k in keys]
    assert apply(spark, names, "string", colors.hash_color) == expected


def test_colors_in_turn(spark):
    assert apply(spark, [0, 9, 10, 23, None], "int", colors.cyclic_color) == ["red", "black", "red", "purple", "gray"]


def test_large_infinite_and_unreadable_money(spark):
    values = [1e13 + 0.125, 9e12 + 0.125, 1e13 + 0.375, 3e15, float("inf"), float("-inf")]
    assert apply(spark, values, "double", display.two_decimals) == [f"{v:,.2f}" for v in values]
    assert apply(spark, ["12.5", "n/a", None], "string", display.format_currency) == ["R$ 12,50", "R$ 0,00", "R$ 0,00"]
