"""Facet values kept in sorted runs, so that new values change the runs they fall in and no others."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stopwise.functions.text import integer_value, is_integer_text
from stopwise.operators.numbering import number_within
from stopwise.operators.storage import Scratch, broadcast_checked

# Values of a run; it is cut again when it has twice as many.
RUN_ROWS = 100_000

_KEY = "struct<number:decimal(38,0),upper:string,value:string>"
_ROWS = f"facet string, value string, key {_KEY}, place bigint"
_RUNS = f"facet string, run bigint, low {_KEY}, rows bigint, numeric boolean, folder string, version bigint"


def _key(numeric: Column) -> Column:
    """What values are sorted by: the number where all of a facet's values are numbers, else upper case."""
    return F.struct(
        F.when(numeric, integer_value(F.col("value"))).alias("number"), F.upper("value").alias("upper"), F.col("value").alias("value")
    )


@dataclass(frozen=True)
class SortedRuns:
    """The choices of all facets in order.

    A run is a folder of values next to each other, each with its place in the run, and is never
    changed. A list of runs, with the lowest key and the number of rows of each, is written as one file
    for every version; the newest one counts, so a reader sees a version as a whole. The position of
    a value is its place and the rows of the runs before. There must be one writer at a time.
    """

    spark: SparkSession
    path: str
    run_rows: int = RUN_ROWS

    def runs(self) -> DataFrame | None:
        """The runs of the newest version; one row for ``run_rows`` values or so."""
        try:
            listed = self.spark.read.schema(_RUNS).parquet(f"{self.path}/runs")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        newest = listed.agg(F.max("version")).first()[0]
        return listed.where(F.col("version") == newest).drop("version")

    def _read(self, runs: DataFrame) -> DataFrame:
        """The rows of some runs with their run; only the folders of these are listed."""
        folders = [r.folder for r in runs.select("folder").distinct().collect()]
        if not folders:
            return self.spark.createDataFrame([], f"{_ROWS}, run bigint, folder string")
        rows = self.spark.read.schema(f"{_ROWS}, run bigint, folder string").option("basePath", f"{self.path}/data")
        rows = rows.parquet(*[f"{self.path}/data/folder={f}/run=*" for f in sorted(folders)])
        return rows.join(broadcast_checked(runs.select("facet", "run", "folder")), ["facet", "run", "folder"], "left_semi")

    def values(self) -> DataFrame:
        """``facet``, ``value`` and ``position`` of all values."""
        runs = self.runs()
        if runs is None:
            return self.spark.createDataFrame([], "facet string, value string, position bigint")
        before = Window.partitionBy("facet").orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
        offsets = runs.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0)))
        placed = self._read(runs).join(broadcast_checked(offsets.select("facet", "run", "before")), ["facet", "run"])
        return placed.select("facet", "value", (F.col("place") + F.col("before")).alias("position"))

    def add(self, values: DataFrame) -> None:
        """Merge values (``facet value``) into the runs that they fall in.

        Values that are there already change nothing. Runs between which no value falls are not read.
        If a facet of whole numbers gets its first other value, its order changes, and all its runs are
        sorted again.
        """
        scratch = Scratch(self.spark, "sorted-runs")
        new = scratch.save(values.select("facet", "value").where("facet is not null and value is not null").distinct(), "new")
        kinds = new.groupBy("facet").agg(F.bool_and(is_integer_text(F.col("value"))).alias("numbers"))
        runs = self.runs()
        listed = self.spark.createDataFrame([], _RUNS).drop("version") if runs is None else runs
        # One row a facet, with the ends of its runs: as many as there are runs.
        before = listed.groupBy("facet").agg(
            F.bool_and("numeric").alias("was"), F.sort_array(F.collect_list(F.struct("low", "run"))).alias("lows")
        )
        facets = kinds.join(before, "facet", "left").withColumn("numeric", F.col("numbers") & F.coalesce("was", F.lit(True)))
        facets = scratch.save(facets.withColumn("turned", F.col("was") & ~F.col("numeric")), "facets")
        facets = broadcast_checked(facets)
        keyed = new.join(facets, "facet").withColumn("key", _key(F.col("numeric")))
        # The last run that begins at or before the value, or else the first.
        passed = F.size(F.filter("lows", lambda x: x["low"] <= F.col("key")))
        run = F.when(F.col("turned"), F.lit(0)).otherwise(F.get("lows", F.greatest(passed - 1, F.lit(0)))["run"])
        placed = scratch.save(keyed.select("facet", "value", "key", F.coalesce(run, F.lit(0)).cast("bigint").alias("run")), "placed")

        # New values that a run holds already leave it alone.
        targets = placed.select("facet", "run").distinct()
        turned = facets.where("turned").select("facet")
        touched = listed.join(broadcast_checked(targets), ["facet", "run"], "left_semi").join(turned, "facet", "left_anti")
        touched = touched.unionByName(listed.join(turned, "facet", "left_semi"))
        touched = scratch.save(touched, "touched")
        held = self._read(touched).select("facet", "value", "key", "run")
        again = held.join(turned, "facet", "left_semi").withColumns({"key": _key(F.lit(False)), "run": F.lit(0).cast("bigint")})
        held = held.join(turned, "facet", "left_anti").unionByName(again)
        added = placed.join(held, ["facet", "value"], "left_anti")
        changed = scratch.save(added.select("facet", "run").distinct(), "changed")
        if changed.isEmpty():
            return
        merged = held.unionByName(added).join(broadcast_checked(changed), ["facet", "run"], "left_semi")
        sorted_rows = number_within(merged, ["facet", "run"], [F.col("key")], "place", size_out="size")
        # A run of twice its size is cut into even ones; runs have new numbers, which are of this version only.
        pieces = F.when(F.col("size") >= 2 * self.run_rows, F.ceil(F.col("size") / self.run_rows)).otherwise(F.lit(1))
        each = F.ceil(F.col("size") / pieces)
        piece = F.floor((F.col("place") - 1) / each)
        cut = sorted_rows.select("facet", "value", "key", (F.col("place") - piece * each).alias("place"), "run", piece.alias("piece"))
        cut = scratch.save(cut, "cut")
        ends = cut.groupBy("facet", "run", "piece").agg(F.min("key").alias("low"), F.count(F.lit(1)).alias("rows"))
        next_run = (listed.agg(F.max("run")).first()[0] or 0) + 1
        numbered = number_within(ends.withColumn("_all", F.lit(1)), ["_all"], [F.col("facet"), F.col("low")], "at").drop("_all")
        folder = scratch.root.rsplit("-", 1)[-1]
        numbered = scratch.save(
            numbered.withColumns({"new_run": F.col("at") + next_run, "folder": F.lit(f"f{folder}")}).drop("at"), "numbered"
        )
        names = broadcast_checked(numbered.select("facet", "run", "piece", "new_run"))
        rows = cut.join(names, ["facet", "run", "piece"]).select("facet", "value", "key", "place", F.col("new_run").alias("run"))
        rows.hint("rebalance", "run").sortWithinPartitions("run", "place").write.partitionBy("run").parquet(
            f"{self.path}/data/folder=f{folder}"
        )
        gone = numbered.select("facet", "run").distinct()
        gone = gone.unionByName(listed.join(turned, "facet", "left_semi").select("facet", "run")).distinct()
        kept = listed.join(broadcast_checked(gone), ["facet", "run"], "left_anti")
        made = numbered.join(facets.select("facet", "numeric"), "facet").select(
            "facet", F.col("new_run").alias("run"), "low", "rows", "numeric", "folder"
        )
        # A facet that stays numeric or text keeps the flag of its runs, which is the same for all of them.
        version = 1 if runs is None else self.spark.read.schema(_RUNS).parquet(f"{self.path}/runs").agg(F.max("version")).first()[0] + 1
        every = kept.unionByName(made).withColumn("version", F.lit(version).cast("bigint"))
        every.coalesce(1).write.mode("append").parquet(f"{self.path}/runs")
