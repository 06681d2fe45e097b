"""Readers of the base tables and of the two optional files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.functions.text import strip, to_ts
from stopwise.schemas import NETWORK_COLUMNS, OPTIONAL_COLUMNS, ROSTER_COLUMNS, SOURCE_COLUMNS, TABLES


def load_tables(spark: SparkSession, path: str, names=tuple(TABLES)) -> dict[str, DataFrame]:
    """Read the base tables as Parquet from ``path/<name>``; the schema is declared, not inferred.

    ``deliveries`` may be partitioned by ``departure_date``; the scenarios then prune by it.
    """
    return {name: _read_parquet(spark, f"{path}/{name}", name) for name in names}


def _read_parquet(spark: SparkSession, path: str, name: str) -> DataFrame:
    found = spark.read.parquet(path)
    wanted = _declared(name, {f.name: f.name for f in TABLES[name]}, found)
    partitions = [F.col(c) for c in found.columns if c == "departure_date"]
    return found.select(*wanted, *partitions)


def load_jdbc_tables(
    spark: SparkSession, options: dict[str, str], tables: dict[str, str], bounds: dict[str, tuple[str, int, int, int]]
) -> dict[str, DataFrame]:
    """Read the base tables over JDBC.

    ``options`` holds the connection, ``tables`` maps our table names to those of the database and
    ``bounds`` gives per table the numeric partition column, its range and the number of reads, so
    that no table comes through a single connection.
    """
    loaded = {}
    for name, db_table in tables.items():
        column, low, high, reads = bounds[name]
        reader = spark.read.format("jdbc").options(**options).option("dbtable", db_table)
        reader = reader.options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=reads)
        loaded[name] = from_source_names(name, reader.load())
    return loaded


def from_source_names(name: str, table: DataFrame) -> DataFrame:
    """Rename and cast the columns of the operational database to the names used here."""
    return table.select(*_declared(name, SOURCE_COLUMNS[name], table))


def _declared(name: str, columns: dict[str, str], found: DataFrame) -> list[Column]:
    """The columns by their new names and declared types; unreadable values are null.

    Amounts that the source holds as decimals stay decimals, whose sums are exact in any order.
    A missing column is an error unless the scenarios can do without it.
    """
    types = {f.name: f.dataType for f in TABLES[name]}
    given = {f.name: f.dataType for f in found.schema}
    missing = [old for old, new in columns.items() if old not in found.columns and new not in OPTIONAL_COLUMNS]
    if missing:
        raise ValueError(f"table {name!r} lacks {', '.join(missing)}")
    read = []
    for old, new in columns.items():
        if old in found.columns:
            value = F.col(f"`{old}`")
            if types[new].typeName() == "timestamp_ntz":
                value = to_ts(value)
            elif (types[new].typeName(), given[old].typeName()) != ("double", "decimal"):
                value = value.try_cast(types[new])
            read.append(value.alias(new))
    return read


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    """Route roster: ``;``-separated, header, UTF-8 with or without byte order mark.

    Columns are found by name, wherever they stand. ``row_no`` is the position in the file (files by
    path), for the rule that the last line of a route wins.
    """
    found = spark.read.csv(path, sep=";", header=True, inferSchema=False, encoding="UTF-8")
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))
    lines = found.select(*[F.col(f"`{old}`").alias(new) for old, new in ROSTER_COLUMNS.items()], place.alias("row_no"))
    return lines.withColumns({"route": strip(F.col("route")), "driver_name": strip(F.col("driver_name"))})


def read_networks(spark: SparkSession, path: str) -> DataFrame:
    """Customer networks: comma-separated with header, three columns kept wherever they stand, all text."""
    found = spark.read.csv(path, header=True, inferSchema=False, encoding="UTF-8")
    return found.select(*[F.col(f"`{old}`").alias(new) for old, new in NETWORK_COLUMNS.items()])
