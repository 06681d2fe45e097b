"""Mixing sources to target weights by weighted sampling without replacement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stopwise.llm.common import packed, scratch, unpacked, words
from stopwise.operators.numbering import number_within

# Weights of the sources in their order, again and again.
WEIGHTS = (5, 2, 1)
# Cells that the keys of a source are counted in; only one cell of a source is ever sorted.
CELLS = 4096


def quality_weight(text: Column) -> Column:
    """From 0.25 to 1: the share of characters that are neither symbols nor digits; of use without labels."""
    body = F.coalesce(text, F.lit(""))
    plain = F.length(F.regexp_replace(body, r"[#*$%&|<>=_~^{}\\0-9]+", ""))
    return F.when(F.length(body) > 0, 0.25 + 0.75 * plain / F.length(body)).otherwise(F.lit(0.25))


def draw_marks(text: Column, key: Column, seed: int) -> Column:
    """A number for each document that depends on seed, key and text only."""
    return F.xxhash64(F.lit(seed), key.cast("string"), text)


def draw_keys(mark: Column, weight: Column) -> Column:
    """Exponential keys, the smaller the likelier a document is drawn, divided by the weight."""
    uniform = (F.shiftrightunsigned(mark, 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(uniform) / weight


def source_targets(sizes: DataFrame, total_share: float, most: float, store) -> DataFrame:
    """(source, size, target) from (source, size, weight): shares by weight, none above ``most`` sizes.

    What a source cannot take is shared among the others by weight until none is above its limit.
    Every round returns two sums to the driver; the level only rises, so few rounds are needed.
    """
    total = sizes.agg(F.sum("size")).first()[0] or 0
    wanted, level = total * total_share, 0.0
    limit = most * F.col("size")
    while total:
        full = F.col("weight") * F.lit(level) > limit if level else F.lit(False)
        taken, weight = sizes.agg(F.sum(F.when(full, limit)), F.sum(F.when(~full, F.col("weight")))).first()
        if not weight:
            break
        higher = (wanted - (taken or 0.0)) / weight
        if higher <= level * (1 + 1e-12):
            break
        level = higher
    return sizes.withColumn("target", F.least(limit, F.col("weight") * F.lit(float(level))).cast("double"))


def mix(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
    total_share: float = 1.5,
    most: float = 2.0,
    weights: tuple[int, ...] = WEIGHTS,
    cells: int = CELLS,
    seed: int = 42,
    weight: Callable[[Column], Column] = quality_weight,
    keep_text: bool = False,
) -> DataFrame:
    """Every row of ``docs`` with how often the mix takes it.

    Columns added (or replaced): ``size`` (words), ``source_size``, ``target`` (words wanted of the
    source), ``copies`` (0 to ``ceil(most)``) and ``taken`` (``copies`` times ``size``). The text comes
    back with ``keep_text`` only.

    Sources in the order of their code points, null last, weigh ``weights`` in turn and share
    ``total_share`` of all words, none more than ``most`` times its size. A source is first taken
    whole as often as its target holds it. For the rest, each document draws an exponential key,
    divided by the quality ``weight`` of its text (above 0; ``weights.fit_weight`` fits one); in the order of the keys, documents are taken until their words
    reach the budget, the last one only if that comes nearer to it. Keys derive from key, text and
    seed, so reruns agree.

    Null texts have size 0; null sources are a source of their own; documents without words are taken
    with their source's whole copies; ties in the order are broken by key, then text, and rows equal
    in both are interchangeable; an empty table gives no rows.

    Only counts per source and cell are shuffled. A source of any share of the rows is counted in
    ``cells`` cells of keys, and just the cell that the budget ends in is sorted.
    """
    rows = packed(docs)
    store = scratch(docs, "mixing")
    body = F.col(f"given.`{text}`")
    kept = [c for c in docs.columns if keep_text or c != text]
    mark = draw_marks(body, F.col(f"given.`{key}`"), seed)
    narrow = rows.select(
        F.struct(*[F.col(f"given.`{c}`") for c in kept], F.lit(1).alias("_unused")).alias("row"),
        F.monotonically_increasing_id().alias("id"),
        F.col(f"given.`{source}`").alias("source"),
        F.size(words(body)).cast("long").alias("size"),
        mark.alias("mark"),
        draw_keys(mark, weight(body)).alias("draw"),
    )
    # exp(-draw / 2) falls as the key rises; its cells are filled about evenly.
    cell = F.least(F.lit(cells - 1), F.floor((1 - F.exp(-F.col("draw") / 2)) * cells)).cast("int")
    narrow = store.save(narrow.withColumn("cell", cell), "documents")

    by_cell = store.save(narrow.groupBy("source", "cell").agg(F.sum("size").alias("words")), "cells")
    sizes = store.save(by_cell.groupBy("source").agg(F.sum("words").alias("size")), "sizes")
    order = [F.col("source").isNull(), F.col("source")]
    turn = F.array(*[F.lit(float(w)) for w in weights])
    numbered = number_within(sizes, [], order, "place").withColumn(
        "weight", turn[((F.col("place") - 1) % len(weights)).cast("int")]
    )
    numbered = store.save(numbered.select("source", "size", "weight"), "weights")
    targets = source_targets(numbered, total_share, most, store)
    whole = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0).cast("int")
    plan = targets.withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("size"))

    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    running = by_cell.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    ends = (
        running.join(plan.select(F.col("source").alias("s"), "budget"), F.col("source").eqNullSafe(F.col("s")))
        .where((F.col("before") < F.col("budget")) & (F.col("before") + F.col("words") >= F.col("budget")))
        .select(F.col("source").alias("s2"), F.col("cell").alias("last_cell"), "before")
    )
    plan = plan.join(ends, F.col("source").eqNullSafe(F.col("s2")), "left").select(
        F.col("source").alias("of"), F.col("size").alias("source_size"), "target", "whole", "budget", "last_cell", "before"
    )
    plan = store.save(plan, "plan")

    # The last document taken in the cell that the budget ends in: one row for each source.
    here = narrow.join(plan, F.col("source").eqNullSafe(F.col("of"))).where(
        (F.col("cell") == F.col("last_cell")) & (F.col("size") > 0)
    )
    sorted_cell = Window.partitionBy("of").orderBy("draw", "mark", "id").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("before") + F.coalesce(F.sum("size").over(sorted_cell), F.lit(0))
    ends_at = (
        here.withColumn("ahead", ahead)
        .where(F.col("ahead") + F.col("size") / 2 <= F.col("budget"))
        .groupBy(F.col("of").alias("s3"))
        .agg(F.max(F.struct("draw", "mark", "id")).alias("end"))
    )
    plan = store.save(plan.join(ends_at, F.col("of").eqNullSafe(F.col("s3")), "left").drop("s3"), "ends")

    drawn = narrow.join(plan, F.col("source").eqNullSafe(F.col("of")))
    inside = (F.col("cell") == F.col("last_cell")) & (F.struct("draw", "mark", "id") <= F.col("end"))
    part = F.when((F.col("cell") < F.col("last_cell")) | inside, 1).otherwise(0)
    part = F.when((F.col("budget") > 0) & (F.col("size") > 0), part).otherwise(0)
    copies = F.col("whole") + part
    return unpacked(
        drawn.withColumn("copies", copies),
        kept,
        size=F.col("size"),
        source_size=F.col("source_size"),
        target=F.col("target"),
        copies=F.col("copies").cast("int"),
        taken=(F.col("copies") * F.col("size")).cast("long"),
    )
