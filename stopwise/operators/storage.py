"""Cutting lineage with tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: dict[str, str] = {}

# Rows that one task may hold or sort as a single group.
TASK_ROWS = 1_000_000
# Measured bytes up to which a table is broadcast.
BROADCAST_BYTES = 32_000_000


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; in local mode a folder of our own if that is unset."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if context.applicationId not in _own_folder:
        _own_folder[context.applicationId] = tempfile.mkdtemp(prefix="stopwise-")
    return _own_folder[context.applicationId]


class Scratch:
    """A folder of written tables; reading one back starts a new, durable lineage."""

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def read(self, pattern: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.root}/{pattern}")


def row_bound(*tables: DataFrame) -> int:
    """Rows of a stored table, counted from its file footers: a proven bound for what derives from it."""
    return sum(t.select(F.lit(1)).count() for t in tables)


def row_bytes(df: DataFrame) -> Column:
    """Bytes of the values of a row: texts as long as they are, every column eight bytes besides."""
    texts = [F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) for f in df.schema if f.dataType.typeName() == "string"]
    return sum(texts, F.lit(8 * len(df.columns))).cast("bigint")


def measured_bytes(df: DataFrame) -> int:
    """Bytes of the values of ``df``."""
    return df.agg(F.sum(row_bytes(df))).first()[0] or 0


def broadcast_checked(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast a table whose values, measured by a job, take no more than ``limit`` bytes.

    Beyond that the join is left to Spark.
    """
    return F.broadcast(df) if measured_bytes(df) <= limit else df
