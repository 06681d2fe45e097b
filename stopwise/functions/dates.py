"""Reference dates of the delivery scenarios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SATURDAY = 7  # dayofweek counts from Sunday = 1


def reference_date(as_of: Column, days: int, saturday_days: int = 2) -> Column:
    """``as_of + days``, but ``as_of + saturday_days`` on Saturdays."""
    shift = F.when(F.dayofweek(as_of) == _SATURDAY, F.lit(saturday_days)).otherwise(F.lit(days))
    return F.date_add(as_of, shift)


def week_start(day: Column) -> Column:
    """Sunday on which the week of ``day`` starts (``trunc`` would give the Monday before)."""
    return F.date_sub(day, F.dayofweek(day) - 1)


def week_mon_tue(as_of: Column) -> Column:
    """Monday and Tuesday of the Sunday-started week; on a Sunday they are the next two days."""
    return F.array(F.date_add(week_start(as_of), 1), F.date_add(week_start(as_of), 2))
