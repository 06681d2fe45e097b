"""Tables kept by day, of which whole days are replaced at once."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

_LOG = "version bigint, day date, snapshot string, epoch int"

# Versions after which the log is begun anew with the days that are valid then.
COMPACT_AFTER = 100


@dataclass(frozen=True)
class DayTable:
    """Rows in folders that are never changed, and a log that names the valid folder of each day.

    Replacing days writes their rows to a new folder, ``data/snapshot=...``, and then appends one file
    to ``log``, which names that folder for all the days at once, also for those without rows any more.
    Spark's commit makes this file visible as a whole, so readers, who look up the log first, see
    either all of the days replaced or none; a run that fails before leaves nothing but an unread
    folder. Folders that readers may still use are left there (see ``superseded``). Readers need no
    lock; there must be one writer at a time.

    The log holds one row per day and version. Every ``COMPACT_AFTER`` versions it goes on in a new
    folder, ``epoch=...``, that begins with a single file of all valid days; readers take the newest.
    """

    spark: SparkSession
    path: str
    day: str

    def replace(self, rows: DataFrame, days: DataFrame | Iterable[date] | None = None) -> None:
        """Make ``rows`` all that there is of ``days``, or, without them, of the days that the rows have.

        ``days`` has a column named as the table's day; rows of other days are not read later.
        """
        snapshot = f"s{uuid.uuid4().hex}"  # never read as a number
        folder = f"{self.path}/data/snapshot={snapshot}"
        # Files of even size, sorted so that readers of some days skip what they do not need.
        rows.hint("rebalance", self.day).sortWithinPartitions(self.day).write.parquet(folder)
        if days is None:
            days = self.spark.read.schema(rows.schema).parquet(folder).select(self.day)
        elif not isinstance(days, DataFrame):
            days = self.spark.createDataFrame([(d,) for d in days], f"`{self.day}` date")
        self._publish(days.select(F.col(self.day).cast("date").alias("day")).where("day is not null").distinct(), snapshot)

    def _publish(self, days: DataFrame, snapshot: str) -> None:
        log, epoch = self._log()
        version, versions = 1, 0
        if log is not None:
            last, versions = log.agg(F.max("version"), F.countDistinct("version")).first()
            version = last + 1
        entries = days.select(F.lit(version).cast("bigint").alias("version"), "day", F.lit(snapshot).alias("snapshot"))
        if versions >= COMPACT_AFTER:
            # The days that stay get this version too, so that those of an epoch count what was appended to it.
            others = self._valid(log).join(days, "day", "left_anti").withColumn("version", F.lit(version).cast("bigint"))
            entries = others.unionByName(entries)
            epoch += 1
        # One row per day: a single file, and so a single step.
        entries.coalesce(1).write.mode("append").parquet(f"{self.path}/log/epoch={epoch}")

    def _log(self) -> tuple[DataFrame | None, int]:
        try:
            log = self.spark.read.schema(_LOG).parquet(f"{self.path}/log")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None, 0
        epoch = log.agg(F.max("epoch")).first()[0]
        return log.where(F.col("epoch") == epoch), epoch

    @staticmethod
    def _valid(log: DataFrame) -> DataFrame:
        newest = log.groupBy("day").agg(F.max(F.struct("version", "snapshot")).alias("newest"))
        return newest.select("day", "newest.version", "newest.snapshot")

    def days(self, first: date | None = None, last: date | None = None) -> dict[date, str]:
        """The valid snapshot of every day that was ever written; at most one entry a calendar day."""
        log, _ = self._log()
        if log is None:
            return {}
        for bound, compare in ((first, F.col("day") >= F.lit(first)), (last, F.col("day") <= F.lit(last))):
            log = log if bound is None else log.where(compare)
        return {row.day: row.snapshot for row in self._valid(log).collect()}

    def read(
        self,
        schema: StructType | None = None,
        first: date | None = None,
        last: date | None = None,
        only: Iterable[date] | None = None,
    ) -> DataFrame:
        """The valid rows of all days, or of those in a range or a list, as of now.

        Only folders named by the log are listed, and of these only the files, row groups and pages
        that hold such days are read. Later replacements do not change what this DataFrame reads. If no
        day was ever written, the table is empty and ``schema`` must be given.
        """
        valid = self.days(first, last)
        if only is not None:
            valid = {day: valid[day] for day in sorted(set(only)) if day in valid}
        if not valid:
            some = self.days()
            if schema is None and some:
                schema = self.spark.read.parquet(f"{self.path}/data/snapshot={min(some.values())}").schema
            if schema is None:
                raise ValueError(f"nothing was written to {self.path}")
            return self.spark.createDataFrame([], schema)
        folders = [f"{self.path}/data/snapshot={s}" for s in sorted(set(valid.values()))]
        reader = self.spark.read.option("basePath", f"{self.path}/data")
        if schema is not None:
            reader = reader.schema(StructType([*schema.fields, StructField("snapshot", StringType())]))
        rows = reader.parquet(*folders)
        rows = rows.where(F.col(self.day).between(F.lit(min(valid)), F.lit(max(valid))))
        # One row a day, so this is small whatever the table holds.
        marks = self.spark.createDataFrame(list(valid.items()), "_day date, _snapshot string")
        is_valid = (F.col(self.day) == F.col("_day")) & (F.col("snapshot") == F.col("_snapshot"))
        return rows.join(F.broadcast(marks), is_valid, "left_semi").drop("snapshot")

    def superseded(self) -> list[str]:
        """Folders named by the newest part of the log that no day is read from any more."""
        log, _ = self._log()
        if log is None:
            return []
        named = {row.snapshot for row in log.select("snapshot").distinct().collect()}
        return sorted(f"{self.path}/data/snapshot={s}" for s in named - set(self.days().values()))
