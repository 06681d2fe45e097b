"""Schemas of the tables the reports read."""

from __future__ import annotations

from pyspark.sql import types as T

DELIVERIES = T.StructType([
    T.StructField("delivery_id", T.LongType()),
    T.StructField("customer_id", T.LongType()),
    T.StructField("op_code", T.IntegerType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("driver_id", T.LongType()),
    T.StructField("departure_ts", T.TimestampNTZType()),
    T.StructField("weight_kg", T.DoubleType()),
    T.StructField("revenue", T.DoubleType()),
])

CUSTOMERS = T.StructType([
    T.StructField("customer_id", T.LongType()),
    T.StructField("trade_name", T.StringType()),
    T.StructField("person_name", T.StringType()),
    T.StructField("lat_raw", T.StringType()),
    T.StructField("lon_raw", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("is_client", T.IntegerType()),
    T.StructField("priority_raw", T.StringType()),
    T.StructField("saturday_priority", T.IntegerType()),
    T.StructField("area_id", T.LongType()),
    T.StructField("vendor_id", T.LongType()),
    T.StructField("supervisor_id", T.LongType()),
])

DRIVERS = T.StructType([
    T.StructField("driver_id", T.LongType()),
    T.StructField("driver_name", T.StringType()),
])

AREAS = T.StructType([
    T.StructField("area_id", T.LongType()),
    T.StructField("area_desc", T.StringType()),
])

# Columns that the reports can do without.
OPTIONAL_COLUMNS = {"saturday_priority"}

TABLES = {"deliveries": DELIVERIES, "customers": CUSTOMERS, "drivers": DRIVERS, "areas": AREAS}

# Column names of the operational database (fixed values), by table.
SOURCE_COLUMNS = {
    "deliveries": {
        "M06_ID": "delivery_id",
        "M06_ID_CLIENTE": "customer_id",
        "M06_ID_A76": "op_code",
        "M06_STATUS": "status",
        "M06_ID_M13": "driver_id",
        "M06_DTSAIDA": "departure_ts",
        "M06_VOL_PESOL": "weight_kg",
        "M06_TOTPRO": "revenue",
    },
    "customers": {
        "A00_ID": "customer_id",
        "A00_FANTASIA": "trade_name",
        "A00_NOME": "person_name",
        "A00_LAT": "lat_raw",
        "A00_LONG": "lon_raw",
        "A00_STATUS": "status",
        "A00_EN_CL": "is_client",
        "A00_ID_A56_SEMANA": "priority_raw",
        "A00_ID_A56_SABADO": "saturday_priority",
        "A00_ID_A14": "area_id",
        "A00_ID_VEND": "vendor_id",
        "A00_ID_VEND_2": "supervisor_id",
    },
    "drivers": {"M13_ID": "driver_id", "M13_DESC": "driver_name"},
    "areas": {"A14_ID": "area_id", "A14_DESC": "area_desc"},
}

# Columns of the two optional files, in file order (fixed values), with the names used here.
ROSTER_COLUMNS = {
    "A14_ID": "area_id", "COD ROTA": "route_code", "ROTA": "route", "MOTORISTA": "driver_name", "SEMANA": "week_code",
}
NETWORK_COLUMNS = {"A00_ID": "customer_id", "REDE": "network", "SUBREDE": "subnetwork"}
