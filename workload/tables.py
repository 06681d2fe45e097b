"""Delivery tables derived from the star schema that the queries are given.

Every column is computed by Spark from ``customer orders lineitem supplier nation``, so the work of
each query grows with those tables. The same expressions are written as SQL in ``oracle.py``.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.operators.calendar import Calendar

OP_CODES = (38, 39, 100, 1171, 101, 172, 112, 130, 113, 45, 46, 104, 105, 110, 111, 114, 115, 49, 50, 61, 999)
EXCLUDED = ("005 - L80-NATION_5", "002 - L80-NATION_2")


# Schemas of the given tables, declared so that reading them needs no job of its own.
SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
    " l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
    " l_shipdate timestamp_ntz",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def whole_calendar(spark: SparkSession, sf_dir: str) -> Calendar:
    """Every day from the first order to the last; one day if there are no orders."""
    leaves = F.col("o_orderdate").cast("date")
    first, last = table(spark, sf_dir, "orders").agg(F.min(leaves), F.max(leaves)).first()
    return Calendar.span(spark, first or date(1970, 1, 1), last or date(1970, 1, 1))


def deliveries_of(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    weights = lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("weight_kg"))
    codes = F.array(*[F.lit(c) for c in OP_CODES])
    headers = orders.select(
        "o_orderkey",
        F.col("o_custkey").alias("customer_id"),
        F.element_at(codes, (key % len(OP_CODES) + 1).cast("int")).alias("op_code"),
        F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 3).otherwise(2).alias("status"),
        F.when(key % 37 != 0, key % 11).alias("driver_id"),
        F.col("o_orderdate").alias("departure_ts"),
        F.when(key % 41 != 0, F.col("o_totalprice")).alias("revenue"),
    )
    return headers.join(weights, "o_orderkey", "left").withColumnRenamed("o_orderkey", "delivery_id")


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deliveries_of(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    lat = F.lit(-3.0) - ((key * 7919) % 10007) / F.lit(10007.0) * 2.0
    lon = F.lit(-38.0) - ((key * 104729) % 10009) / F.lit(10009.0) * 2.5
    return table(spark, sf_dir, "customer").select(
        key.alias("customer_id"),
        F.col("c_name").alias("trade_name"),
        F.col("c_name").alias("person_name"),
        F.when(key % 29 == 3, "n/a").when(key % 29 == 5, "95.5").when(key % 29 != 7, lat.cast("string")).alias("lat_raw"),
        lon.cast("string").alias("lon_raw"),
        F.when(key % 20 == 0, 2).otherwise(1).alias("status"),
        F.when(key % 25 == 7, 0).otherwise(1).alias("is_client"),
        F.when(key % 4 != 0, key % 4).alias("priority_raw"),
        (key % 5).cast("int").alias("saturday_priority"),
        F.when(key % 31 != 0, F.col("c_nationkey")).alias("area_id"),
        (key % 97).alias("vendor_id"),
        F.when(key % 13 != 0, key % 7).alias("supervisor_id"),
    )


def drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("driver_id"), F.col("s_name").alias("driver_name")
    )


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    code = F.when(key % 3 == 0, "L81-").when(key % 3 == 1, "L82-").otherwise("L80-")
    text = F.concat(F.lpad(key.cast("string"), 3, "0"), F.lit(" - "), code, F.col("n_name"))
    return table(spark, sf_dir, "nation").select(
        key.alias("area_id"), F.when(key == 24, F.col("n_name")).otherwise(text).alias("area_desc")
    )


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    route = F.concat(
        F.when(key % 5 == 0, "  ").otherwise(""), F.lit("L82-"), F.col("n_name"), F.when(key % 4 == 0, " ").otherwise("")
    )
    weeks = F.when(key % 2 == 1, F.array(F.lit("A"), F.lit("B"))).otherwise(F.array(F.lit("A")))
    lines = (
        table(spark, sf_dir, "nation")
        .where((key % 3 == 1) & (key != 22))
        .select(key.alias("key"), route.alias("route"), F.explode(weeks).alias("week_code"))
    )
    driver = (F.col("key") + F.when(F.col("week_code") == "B", F.col("key") % 2).otherwise(0)) % 4
    return lines.select(
        F.struct("week_code", "key").alias("row_no"),
        "route",
        F.concat(F.lit("DRV_"), driver.cast("string")).alias("driver_name"),
        "week_code",
    )


def networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    chosen = table(spark, sf_dir, "customer").where(key % 3 == 0)
    lines = F.array(
        F.struct(
            F.concat(F.lit("NET_"), (key % 9).cast("string")).alias("network"),
            F.when(key % 6 != 0, F.concat(F.lit("SUB_"), (key % 4).cast("string"))).alias("subnetwork"),
        ),
        F.when(key % 33 == 0, F.struct(F.lit("NET_X").alias("network"), F.lit("SUB_X").alias("subnetwork"))),
    )
    return chosen.select(
        F.concat(F.when(key % 2 == 0, " ").otherwise(""), key.cast("string"), F.lit(" ")).alias("customer_id"),
        F.explode(F.filter(lines, lambda x: x.isNotNull())).alias("line"),
    ).select("customer_id", "line.network", "line.subnetwork")
