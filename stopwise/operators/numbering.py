"""Row numbers within a group that may be too large for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopwise.operators.storage import TASK_ROWS, Scratch

_ROW_BITS = 33  # monotonically_increasing_id: partition above, row within it below


def number_within(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    out: str,
    rows_per_group: int | None = None,
    limit: int = TASK_ROWS,
    size_out: str | None = None,
) -> DataFrame:
    """Add ``out`` = 1, 2, ... within each ``keys`` group in the given order, and its size as ``size_out``.

    ``rows_per_group`` is a bound the caller has proved (the size of a dimension table, say). When it
    fits one task, this is ``row_number``. Otherwise no group is gathered: the rows are range sorted
    over all tasks and written once, and each gets its place in its partition plus the number of rows
    of its group in the partitions before.
    """
    if rows_per_group is not None and rows_per_group <= limit:
        group = Window.partitionBy(*keys)
        numbered = df.withColumn(out, F.row_number().over(group.orderBy(*order)).cast("bigint"))
        return numbered.withColumn(size_out, F.count(F.lit(1)).over(group)) if size_out else numbered

    by = [F.col(k) for k in keys] + order
    sorted_rows = df.repartitionByRange(*by).sortWithinPartitions(*by)
    placed = Scratch(df.sparkSession, "numbering").save(
        sorted_rows.withColumn("_place", F.monotonically_increasing_id()), "sorted"
    ).withColumn("_part", F.shiftright("_place", _ROW_BITS))

    first_places = placed.groupBy(*keys, "_part").agg(
        F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    # One row per group and partition it reaches into, so this window holds few rows per group.
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = first_places.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    if size_out:
        offsets = offsets.withColumn(size_out, F.sum("_rows").over(Window.partitionBy(*keys)))
    # Null keys are a group like any other, so they are joined null-safely.
    theirs = [f"_of_{k}" for k in keys]
    offsets = offsets.withColumnsRenamed(dict(zip([*keys, "_part"], [*theirs, "_of_part"])))
    same = F.col("_part") == F.col("_of_part")
    for key, other in zip(keys, theirs):
        same = same & F.col(key).eqNullSafe(F.col(other))
    return (
        placed.join(offsets, same)
        .withColumn(out, F.col("_place") - F.col("_first") + F.col("_before") + 1)
        .drop("_place", "_part", "_first", "_before", "_rows", "_of_part", *theirs)
    )
