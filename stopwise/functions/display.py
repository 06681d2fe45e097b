"""Texts shown to people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stopwise.constants import DAYTIME_LABEL, MISSING_TEXT, PRIORITY_LABELS

_EXACT_BELOW = 1e13  # up to here a double holds its cents apart from its neighbours
_SPLITTER = 134217729.0  # 2**27 + 1 halves the 53 significant bits


def two_decimals(value: Column) -> Column:
    """``1,234.50``: the exact binary value rounded half to even, as C and Python print it.

    ``format_number`` on a double rounds its shortest decimal text instead, which moves half-cents
    such as 2.675 up. Here the cents are rounded from ``value * 100``; where that product is a half,
    the exact error of the multiplication tells on which side of it the true product lies.
    """
    product = value * 100.0
    carried = value * _SPLITTER
    high = carried - (carried - value)
    error = (high * 100.0 - product) + (value - high) * 100.0
    whole = F.floor(product).cast("double")
    cents = (
        F.when((product - whole != 0.5) | (error == 0), F.rint(product))
        .when(error > 0, whole + 1.0)
        .otherwise(whole)
    )
    exact = (cents.try_cast("decimal(36,0)") / F.lit(100).cast("decimal(3,0)")).try_cast("decimal(38,2)")
    # Above, the value is a multiple of 2**-9; its exact decimal text is rounded half to even.
    large = F.bround(value.try_cast("decimal(38,9)"), 2)
    chosen = F.when(F.abs(value) < _EXACT_BELOW, exact).otherwise(large.cast("decimal(38,2)"))
    # A small negative value keeps its sign when it is rounded to zero.
    sign = F.when((value < 0) & (value > -0.005), F.lit("-")).otherwise(F.lit(""))
    infinite = F.when(value > 0, F.lit("inf")).otherwise(F.lit("-inf"))
    text = F.when(F.isnan(value), F.lit("nan")).when(F.abs(value) == float("inf"), infinite)
    return text.otherwise(F.concat(sign, F.format_number(chosen, 2)))


def format_currency(value: Column) -> Column:
    """``R$ 1.234,50``; missing or unreadable counts as zero."""
    plain = two_decimals(F.coalesce(value.try_cast("double"), F.lit(0.0)))
    return F.concat(F.lit("R$ "), F.translate(plain, ",.", ".,"))


def format_weight(value: Column) -> Column:
    """``1,234.50 kg``; missing or unreadable counts as zero."""
    return F.concat(two_decimals(F.coalesce(value.try_cast("double"), F.lit(0.0))), F.lit(" kg"))


def format_date(value: Column) -> Column:
    """``dd/MM/yyyy``; missing is a dash."""
    return F.coalesce(F.date_format(value, "dd/MM/yyyy"), F.lit(MISSING_TEXT))


def priority_label(priority: Column) -> Column:
    label = F
    for number, text in PRIORITY_LABELS.items():
        label = label.when(priority == number, F.lit(text))
    return label.otherwise(F.lit(DAYTIME_LABEL))
