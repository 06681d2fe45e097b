"""Helpers that the text operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.operators.storage import Scratch

# White space between words, and what is no word of letters and digits.
SPACE = r"[\x20\x09-\x0D]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class TextScratch(Scratch):
    """Written tables of texts: compressed more."""

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def scratch(df: DataFrame, purpose: str) -> TextScratch:
    """A folder for tables that cut lineage, below the folder that all executors share."""
    return TextScratch(df.sparkSession, purpose)


def words(text: Column, separators: str = SPACE) -> Column:
    """The words of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def packed(df: DataFrame) -> DataFrame:
    """All columns of ``df`` in one struct ``given``, so that operators' own columns cannot clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("given"))


def unpacked(df: DataFrame, columns: list[str], **more: Column) -> DataFrame:
    """The columns of the struct ``row`` again; ``more`` replaces or adds columns."""
    lowered = {k.lower(): k for k in more}
    own = [more[lowered[c.lower()]].alias(c) if c.lower() in lowered else F.col(f"row.`{c}`").alias(c) for c in columns]
    taken = {c.lower() for c in columns}
    return df.select(*own, *[v.alias(k) for k, v in more.items() if k.lower() not in taken])
