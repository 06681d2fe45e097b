"""Faceted filtering of the customer master."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopwise.functions.text import integer_value, is_integer_text, text_or_empty
from stopwise.operators.numbering import number_within
from stopwise.operators.storage import TASK_ROWS, Scratch

# Facet names and the master columns behind them.
FACETS = {
    "region": "region",
    "area": "area_desc",
    "id": "customer_id",
    "customer": "trade_name",
    "vendor": "vendor_name",
    "supervisor": "supervisor",
    "network": "network",
    "subnetwork": "subnetwork",
}
_MAY_BE_BLANK = ("network", "subnetwork")  # blank and 'nan' stand for "no network", not for a value

ALL = "*all*"  # selects every value of a facet, as its "select all" box does

Selection = Mapping[str, "Sequence[str] | DataFrame | str"]


def present_facets(df: DataFrame) -> dict[str, str]:
    """The facets of a master and their columns."""
    return {facet: column for facet, column in FACETS.items() if column in df.columns}


def _facet_rows(master: DataFrame) -> DataFrame:
    """One row per facet value of every customer, without the values that are no choice."""
    pairs = [
        F.struct(F.lit(facet).alias("facet"), F.col(column).cast("string").alias("value"))
        for facet, column in present_facets(master).items()
    ]
    rows = master.select(F.explode(F.array(*pairs)).alias("pair")).select("pair.*")
    blank = F.col("facet").isin(*_MAY_BE_BLANK) & F.col("value").isin("", "nan")
    return rows.where(F.col("value").isNotNull() & ~blank)


def facet_values(master: DataFrame, rows_per_facet: int | None = None) -> DataFrame:
    """Choices of each facet with their position in its list.

    A facet whose values are all whole numbers is sorted by number, any other by upper-case text.
    The identifier facets have as many values as there are customers, so the positions come from
    ``number_within``; ``rows_per_facet`` is a proved bound on the customers, if there is one.
    """
    values = _facet_rows(master).distinct()
    integers = F.bool_and(is_integer_text(F.col("value")))
    if rows_per_facet is not None and rows_per_facet <= TASK_ROWS:
        typed = values.withColumn("numeric", integers.over(Window.partitionBy("facet")))
    else:
        values = Scratch(master.sparkSession, "facets").save(values, "values")
        # One row per facet, so eight at most.
        typed = values.join(F.broadcast(values.groupBy("facet").agg(integers.alias("numeric"))), "facet")
    keyed = typed.select(
        "facet",
        "value",
        F.when(F.col("numeric"), integer_value(F.col("value"))).alias("_number"),
        F.upper("value").alias("_upper"),
    )
    by = [F.col("_number"), F.col("_upper"), F.col("value")]
    return number_within(keyed, ["facet"], by, "position", rows_per_facet).select("facet", "value", "position")


def facet_search(values: DataFrame, facet: str, term: str) -> DataFrame:
    """Values of a facet that contain the term, in any case."""
    return values.where((F.col("facet") == facet) & F.contains(F.lower("value"), F.lower(F.lit(term))))


def facet_filter(master: DataFrame, selection: Selection) -> DataFrame:
    """Customers that match one selected value in every facet that has a selection.

    A facet selects a list of values, a DataFrame with a ``value`` column, or ``ALL``. A missing
    attribute counts as the empty text.
    """
    shown = master
    for facet, chosen in selection.items():
        column = text_or_empty(F.col(FACETS[facet]))
        if isinstance(chosen, DataFrame):
            wanted = chosen.select(F.col("value").alias("_value")).distinct()
            shown = shown.withColumn("_value", column).join(wanted, "_value", "left_semi").drop("_value")
        elif chosen == ALL:
            shown = shown.where(_any_value(master, facet))
        elif chosen:
            shown = shown.where(column.isin(*chosen))
    return shown


def _any_value(master: DataFrame, facet: str) -> Column:
    """Whether a customer's attribute is among all the values of the facet.

    Those values come from the same master, so a present attribute is always among them and no join
    is needed. A missing one counts as empty text, which is a value only if some customer has it.
    """
    column = F.col(FACETS[facet])
    if facet in _MAY_BE_BLANK:
        return ~text_or_empty(column).isin("", "nan")
    has_blank = master.where(column == "").select(F.lit(1)).exists()
    return column.isNotNull() | has_blank


def facet_select_all(master: DataFrame, facet: str) -> DataFrame:
    return facet_filter(master, {facet: ALL})


def visible_vendors(shown: DataFrame) -> DataFrame:
    """Vendors of the customers shown, each once."""
    return shown.where(F.coalesce("vendor_name", F.lit("")) != "").select("vendor_name").distinct()


def facet_filter_summary(shown: DataFrame) -> DataFrame:
    """Number of customers shown and of their vendors."""
    return shown.agg(
        F.count(F.lit(1)).alias("customers"),
        F.countDistinct(F.nullif(F.col("vendor_name"), F.lit(""))).alias("vendors"),
    )
