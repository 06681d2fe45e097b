"""Indexes of the customer master's facets: counts of many selections at once, and search in facet values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise.functions.text import text_or_empty
from stopwise.operators.facets import facet_search, present_facets
from stopwise.operators.numbering import number_within
from stopwise.operators.storage import Scratch, broadcast_checked

# Customers of a value from which on it is kept as bitmaps; the customers of rarer values are a row each.
DENSE = 512
# The facet and value that all customers have.
EVERY = "*"
# Folders of the search index, and letters that a term must have for it to be used.
PARTS, LETTERS = 64, 3


@dataclass(frozen=True)
class FacetIndex:
    """Which customers have which facet values, by the place of the customer.

    ``bitmaps`` has the bits of every bucket of places for values of many customers, ``places`` a row
    for each customer of the others. Both are written tables.
    """

    bitmaps: DataFrame
    places: DataFrame


def build_facet_index(master: DataFrame, dense: int = DENSE) -> FacetIndex:
    """Index the facets of a master; rows of one customer with several networks are a place each.

    Places follow area, supervisor and vendor, so that the bits of a value lie in few buckets. Bitmaps
    are combined before they are shuffled, so a value that most customers have is no hot key.
    """
    facets = present_facets(master)
    store = Scratch(master.sparkSession, "facet-index")
    first = [c for c in ("area_desc", "supervisor", "vendor_name") if c in facets.values()]
    columns = [*first, *[c for c in facets.values() if c not in first]]
    numbered = number_within(master.select(F.lit(1).alias("_all"), *columns), ["_all"], [F.col(c) for c in columns], "place")
    pairs = [F.struct(F.lit(f).alias("facet"), text_or_empty(F.col(c)).alias("value")) for f, c in facets.items()]
    pairs.append(F.struct(F.lit(EVERY).alias("facet"), F.lit(EVERY).alias("value")))
    rows = numbered.select(
        F.bitmap_bucket_number("place").alias("bucket"),
        F.bitmap_bit_position("place").alias("bit"),
        F.explode(F.array(*pairs)).alias("pair"),
    ).select("pair.*", "bucket", "bit")
    rows = store.save(rows, "rows")
    counts = rows.groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))
    common = store.save(counts.where((F.col("n") >= dense) | (F.col("facet") == EVERY)).select("facet", "value"), "common")
    common = broadcast_checked(common)
    bits = F.bitmap_construct_agg("bit").alias("bits")
    bitmaps = rows.join(common, ["facet", "value"], "left_semi").groupBy("facet", "value", "bucket").agg(bits)
    places = rows.join(common, ["facet", "value"], "left_anti").repartitionByRange("facet", "value", "bucket")
    return FacetIndex(
        store.save(bitmaps, "bitmaps"), store.save(places.sortWithinPartitions("facet", "value", "bucket", "bit"), "places")
    )


def _has(bits: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substr(bits, F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    one = F.call_function("shiftleft", F.lit(1), bit.bitwiseAND(7).cast("int"))
    return byte.bitwiseAND(one) != 0


def facet_summaries(index: FacetIndex, selections: DataFrame) -> DataFrame:
    """Customers shown and their vendors for every selection, in one job that never reads the master.

    ``selections`` has a row (``selection``, ``facet``, ``value``) for each value selected; a missing
    attribute is selected as the empty text. A customer is shown if it has one of the values in every
    facet that the selection names. A selection whose rows have no facet shows all. The bitmaps of a
    facet's values are combined by or, those of the facets by and.
    """
    named = selections.where("facet is not null").select("selection", "facet", F.coalesce("value", F.lit("")).alias("value"))
    every = selections.select("selection", F.lit(EVERY).alias("facet"), F.lit(EVERY).alias("value"))
    chosen = named.unionByName(every).distinct()
    facets = chosen.groupBy("selection").agg(F.countDistinct("facet").alias("facets"))
    by_facet = ["selection", "facet", "bucket"]
    of_common = index.bitmaps.join(chosen, ["facet", "value"]).select(*by_facet, "bits")
    of_rare = index.places.join(chosen, ["facet", "value"]).groupBy(*by_facet).agg(F.bitmap_construct_agg("bit").alias("bits"))
    any_value = of_common.unionByName(of_rare).groupBy(*by_facet).agg(F.bitmap_or_agg("bits").alias("bits"))
    all_facets = any_value.groupBy("selection", "bucket").agg(
        F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("met")
    )
    met = F.col("met") == F.col("facets")
    shown = all_facets.join(facets, "selection").where(met & (F.bitmap_count("bits") > 0)).select("selection", "bucket", "bits")
    shown = Scratch(selections.sparkSession, "facet-counts").save(shown, "shown")
    customers = shown.groupBy("selection").agg(F.sum(F.bitmap_count("bits")).alias("customers"))

    is_vendor = (F.col("facet") == "vendor") & (F.col("value") != "")
    common = index.bitmaps.where(is_vendor).select("value", "bucket", F.col("bits").alias("theirs"))
    both = shown.join(common, "bucket").select("selection", "value", "bucket", F.explode(F.array("bits", "theirs")).alias("bits"))
    both = both.groupBy("selection", "value", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"))
    rare = index.places.where(is_vendor).join(shown, "bucket").where(_has(F.col("bits"), F.col("bit")))
    seen = both.where(F.bitmap_count("bits") > 0).select("selection", "value").unionByName(rare.select("selection", "value"))
    vendors = seen.distinct().groupBy("selection").agg(F.count(F.lit(1)).alias("vendors"))
    found = selections.select("selection").distinct().join(customers, "selection", "left").join(vendors, "selection", "left")
    return found.select(
        "selection",
        F.coalesce("customers", F.lit(0)).cast("bigint").alias("customers"),
        F.coalesce("vendors", F.lit(0)).cast("bigint").alias("vendors"),
    )


@dataclass(frozen=True)
class ValueIndex:
    """Facet values by the three-letter pieces that they hold, in folders by piece.

    ``values`` has each value once, ``pieces`` once for every piece, sorted by piece, and ``counts``
    the number of values of a piece.
    """

    values: DataFrame
    pieces: DataFrame
    counts: DataFrame


def _part(piece: Column) -> Column:
    return F.pmod(F.xxhash64(piece), F.lit(PARTS)).cast("int")


def build_value_index(values: DataFrame) -> ValueIndex:
    """Index facet values (``facet value position``) for search."""
    spark = values.sparkSession
    store = Scratch(spark, "value-index")
    values = store.save(values, "values")
    low = F.lower("value")
    starts = F.sequence(F.lit(1), F.length(low) - (LETTERS - 1))
    found = F.array_distinct(F.transform(starts, lambda i: F.substr(low, i, F.lit(LETTERS))))
    rows = values.where(F.length(low) >= LETTERS).select(F.explode(found).alias("piece"), "facet", "value", "position")
    rows = rows.withColumn("part", _part(F.col("piece")))
    path = f"{store.root}/pieces"
    # The rebalance splits the folder of a very common piece over several files.
    rows.hint("rebalance", "part").sortWithinPartitions("part", "piece", "facet").write.partitionBy("part").parquet(path)
    pieces = spark.read.schema(rows.schema).parquet(path)
    counts = pieces.groupBy("part", "facet", "piece").agg(F.count(F.lit(1)).alias("n"))
    return ValueIndex(values, pieces, store.save(counts.repartitionByRange("piece").sortWithinPartitions("piece"), "counts"))


def indexed_search(index: ValueIndex, facet: str, term: str) -> DataFrame:
    """Values of a facet that contain the term, in any case: the same as ``facet_search``.

    Only the values of the term's rarest piece are read, and checked. A term of fewer letters than a
    piece has is looked for in all values.
    """
    spark = index.values.sparkSession
    (low,) = spark.range(1).select(F.lower(F.lit(term))).first()
    pieces = sorted({low[i : i + LETTERS] for i in range(len(low) - LETTERS + 1)})
    if not pieces:
        return facet_search(index.values, facet, term)
    known = index.counts.where((F.col("facet") == facet) & F.col("piece").isin(pieces)).select("piece", "n").collect()
    if len(known) < len(pieces):
        return index.values.where(F.lit(False))
    rarest = min(known, key=lambda r: (r.n, r.piece)).piece
    near = index.pieces.where((F.col("part") == _part(F.lit(rarest))) & (F.col("piece") == rarest))
    return facet_search(near.select("facet", "value", "position"), facet, term)
