"""Colours of routes, supervisors and vendors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stopwise.constants import (
    HASH_SATURATION,
    HASH_VALUE,
    NO_ROUTE_COLOR,
    NO_SUPERVISOR,
    PALETTE_SATURATION,
    PALETTE_VALUE,
    ROUTE_COLORS,
)
from stopwise.functions.text import strip


def cyclic_color(index: Column) -> Column:
    """The route colours taken in turn; no index, no colour of its own."""
    names = F.array(*[F.lit(c) for c in ROUTE_COLORS])
    slot = F.pmod(index, F.lit(len(ROUTE_COLORS))).cast("int")
    return F.when(index.isNotNull(), F.get(names, slot)).otherwise(F.lit(NO_ROUTE_COLOR))


def hsv_hex(hue: Column, saturation: float, value: float, rounded: bool = False) -> Column:
    """``#rrggbb`` of a hue in 0..1. Channels are cut to whole numbers, or rounded half up."""
    scaled = hue * 6
    sector = F.floor(scaled)
    part = scaled - sector
    flat = F.lit(value * (1.0 - saturation))
    falling = F.lit(value) * (1.0 - part * F.lit(saturation))
    rising = F.lit(value) * (1.0 - (1.0 - part) * F.lit(saturation))
    full = F.lit(value)
    by_sector = (
        (full, rising, flat),
        (falling, full, flat),
        (flat, full, rising),
        (flat, falling, full),
        (rising, flat, full),
        (full, flat, falling),
    )
    shift = 0.5 if rounded else 0.0

    def channel(i: int) -> Column:
        chosen = F
        for number, triple in enumerate(by_sector):
            chosen = chosen.when(F.pmod(sector, F.lit(6)) == number, triple[i])
        return F.lower(F.lpad(F.hex(F.floor(chosen * 255 + shift)), 2, "0"))

    return F.concat(F.lit("#"), channel(0), channel(1), channel(2))


def palette_color(index: Column, count: Column, rounded: bool = False) -> Column:
    """Colour ``index`` of ``count`` evenly spaced hues."""
    hue = index.cast("double") / F.greatest(count, F.lit(1)).cast("double")
    return hsv_hex(hue, PALETTE_SATURATION, PALETTE_VALUE, rounded)


def hash_color(name: Column) -> Column:
    """Colour that depends on the name alone, whatever else is shown beside it."""
    key = F.lower(strip(F.coalesce(F.nullif(name, F.lit("")), F.lit(NO_SUPERVISOR))))
    digits = F.conv(F.substring(F.md5(key), 1, 6), 16, 10).cast("double")
    return hsv_hex(digits / F.lit(float(0xFFFFFF)), HASH_SATURATION, HASH_VALUE)
