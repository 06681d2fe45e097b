"""Colours of supervisors and vendors on the customer map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise.constants import NO_MARKER_COLOR
from stopwise.functions.colors import palette_color
from stopwise.operators.facets import ALL, FACETS, Selection, facet_filter, visible_vendors
from stopwise.operators.numbering import number_within
from stopwise.operators.storage import Scratch, broadcast_checked

# Entries of one palette text; longer palettes are written as several texts.
JSON_ENTRIES = 1_000


def _palette(names: DataFrame, order: list[Column], rounded: bool, rows: int | None) -> DataFrame:
    """Position and colour of each distinct name; the hues are spread over the number of names.

    Without a proved bound ``rows`` the names are written, which are few, and counted.
    """
    if rows is None:
        names = Scratch(names.sparkSession, "palette").save(names, "names")
        rows = names.count()
    everything = names.withColumn("_all", F.lit(0))
    numbered = number_within(everything, ["_all"], order, "_number", rows, size_out="_count")
    position = F.col("_number") - 1
    color = palette_color(position, F.col("_count"), rounded)
    return numbered.select("name", position.alias("position"), color.alias("color"))


def supervisor_palette(master: DataFrame, rows: int | None = None) -> DataFrame:
    """Colours of the supervisors by upper-case name; channels are cut to whole numbers."""
    names = master.select(F.col("supervisor").alias("name")).distinct()
    return _palette(names, [F.upper("name"), F.col("name")], False, rows)


def vendor_palette(shown: DataFrame, rows: int | None = None) -> DataFrame:
    """Colours of the vendors shown, by name as written; channels are rounded."""
    names = visible_vendors(shown).withColumnRenamed("vendor_name", "name")
    return _palette(names, [F.col("name")], True, rows)


def by_vendor(selection: Selection, master: DataFrame) -> bool:
    """Colours follow the vendors when exactly one supervisor is selected."""
    chosen = selection.get("supervisor", ())
    if isinstance(chosen, DataFrame):
        return len(chosen.select("value").distinct().take(2)) == 1
    if chosen == ALL:
        return len(master.select(FACETS["supervisor"]).distinct().take(2)) == 1
    return len(set(chosen)) == 1


def master_legend(master: DataFrame, selection: Selection, rows: int | None = None) -> DataFrame:
    """Names and colours beside the map: vendors shown, or all supervisors."""
    if by_vendor(selection, master):
        return vendor_palette(facet_filter(master, selection), rows)
    return supervisor_palette(master, rows)


def colored_master(master: DataFrame, selection: Selection, rows: int | None = None) -> DataFrame:
    """Customers shown, each with the colour of its vendor or supervisor.

    The master is written once, because both the names and the customers are read from it.
    """
    store = Scratch(master.sparkSession, "colored")
    master = store.save(master, "master")
    vendors = by_vendor(selection, master)
    shown = facet_filter(master, selection)
    palette = vendor_palette(shown, rows) if vendors else supervisor_palette(master, rows)
    key = "vendor_name" if vendors else "supervisor"
    colors = store.save(palette.select(F.col("name").alias(key), "color"), "colors")
    return shown.join(broadcast_checked(colors), key, "left").withColumn("color", F.coalesce("color", F.lit(NO_MARKER_COLOR)))


def customer_markers(master: DataFrame, rows: int | None = None) -> DataFrame:
    """Marker of each customer: its place, the facet attributes and its supervisor's colour."""
    columns = [c for c in FACETS.values() if c in master.columns]
    return colored_master(master, {}, rows).select("lat", "lon", *columns, "color")


def palette_json(palette: DataFrame, entries: int = JSON_ENTRIES) -> DataFrame:
    """Palette as JSON texts, a name-to-colour map and a list, in parts of bounded length."""
    part = F.floor(F.col("position") / entries).cast("int")
    entry = F.struct("position", "name", "color")
    ordered = (
        palette.withColumn("part", part).groupBy("part").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    )
    pairs = F.transform("entries", lambda e: F.struct(e["name"].alias("key"), e["color"].alias("value")))
    named = F.transform("entries", lambda e: F.struct(e["name"].alias("name"), e["color"].alias("color")))
    return ordered.select(
        "part", F.to_json(F.map_from_entries(pairs)).alias("color_map"), F.to_json(named).alias("color_list")
    )
