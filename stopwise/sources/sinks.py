"""Written reports."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from stopwise.sources.snapshots import DayTable


def report_table(spark: SparkSession, path: str, scenario: str) -> DayTable:
    """The written reports of one scenario."""
    return DayTable(spark, f"{path}/{scenario}", "as_of")


def write_report(report: DataFrame, path: str, scenario: str, days: DataFrame | Iterable[date] | None = None) -> None:
    """Replace the days of a written report at once, all of them or, if the run fails, none.

    ``days`` (column ``as_of``) are the days the report was made for; those without rows are empty
    afterwards. Without them, the days that the report has rows of are replaced. Other days and other
    scenarios stay as they are.
    """
    report_table(report.sparkSession, path, scenario).replace(report, days)


def read_report(spark: SparkSession, path: str, scenario: str, first: date | None = None, last: date | None = None) -> DataFrame:
    """The written report of a scenario as it is now, or the part of it between two days."""
    return report_table(spark, path, scenario).read(first=first, last=last)
