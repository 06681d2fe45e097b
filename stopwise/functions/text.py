"""Cleaning of text, numbers and timestamps that arrive as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stopwise.constants import DEFAULT_PRIORITY, OTHER_REGION, REGION_LABELS

# Leading or trailing Unicode white space, and the four ASCII separators Python strips as well.
_EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_INFINITY = r"(?i)^\s*\+?inf(inity)?\s*$"
_MINUS_INFINITY = r"(?i)^\s*-inf(inity)?\s*$"
_INTEGER = r"^\s*[+-]?\d+(_\d+)*\s*$"


def strip(col: Column) -> Column:
    """Remove all white space from both ends; ``trim`` would remove spaces only."""
    return F.regexp_replace(col, _EDGES, "")


def to_number(col: Column) -> Column:
    """Parse a number, anything else becomes null; stricter than a cast, which takes ``'1d'``."""
    text = col.cast("string")
    parsed = text.try_cast("double")
    finite = F.when(F.abs(parsed) < F.lit(float("inf")), parsed)
    return (
        F.when(text.rlike(_NUMBER), finite)
        .when(text.rlike(_INFINITY), F.lit(float("inf")))
        .when(text.rlike(_MINUS_INFINITY), F.lit(float("-inf")))
    )


def to_ts(col: Column) -> Column:
    """Parse a timestamp, anything else becomes null."""
    return col.try_cast("timestamp_ntz")


def is_integer_text(col: Column) -> Column:
    return col.rlike(_INTEGER)


def integer_value(col: Column) -> Column:
    """Value of an integer written as text, wide enough for any real identifier."""
    return F.translate(strip(col), "_", "").try_cast("decimal(38,0)")


def clean_route(area_desc: Column) -> Column:
    """Route part of ``"<code> - <route>"``: what follows the first separator, null without one."""
    return strip(F.try_element_at(F.split(area_desc, " - ", 2), F.lit(2)))


def region(area_desc: Column) -> Column:
    """Region named in the area text; the capital wins when both codes occur."""
    upper = F.upper(area_desc)
    found = F
    for code, label in REGION_LABELS:
        found = found.when(upper.contains(code), F.lit(label))
    return found.otherwise(F.lit(OTHER_REGION))


def priority(col: Column) -> Column:
    """Visit priority as a whole number; missing or unreadable counts as the default."""
    return F.coalesce(to_number(col).try_cast("int"), F.lit(DEFAULT_PRIORITY))


def priority_block(col: Column) -> Column:
    """Block in which a stop is visited: 1, then 2, then everything else."""
    return F.when(col == 1, 1).when(col == 2, 2).otherwise(3)


def key_text(col: Column) -> Column:
    """Key as stripped text, for joins between numeric and text identifiers."""
    return strip(col.cast("string"))


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))
