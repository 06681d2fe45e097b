"""The customer master: every active client with its place, area, vendor, supervisor and network."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopwise.constants import EXCLUDED_AREAS, IS_CLIENT, NO_SUPERVISOR
from stopwise.functions.text import key_text, region, to_number
from stopwise.operators.roster import enrich_networks
from stopwise.operators.routes import placeable
from stopwise.operators.storage import BROADCAST_BYTES, Scratch, broadcast_checked, measured_bytes
from stopwise.plans.scenarios import active

ATTRIBUTES = ("region", "area_desc", "customer_id", "trade_name", "vendor_name", "supervisor", "network", "subnetwork")


def customer_master(
    customers: DataFrame,
    areas: DataFrame,
    networks: DataFrame | None = None,
    excluded_areas=EXCLUDED_AREAS,
    extended: bool = True,
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Placed, active clients of the areas not excluded.

    Vendors and supervisors are partners of the same table. ``extended=False`` leaves out region and
    networks, as the smaller variant of the report does. Names and networks of up to ``limit`` bytes
    are broadcast.
    """
    kept_areas = areas.where(F.col("area_desc").isNotNull() & ~F.col("area_desc").isin(*excluded_areas))
    clients = placeable(
        active(customers)
        .where(F.col("is_client") == IS_CLIENT)
        .withColumns({"lat": to_number(F.col("lat_raw")), "lon": to_number(F.col("lon_raw"))}),
        check_range=True,
    ).select("customer_id", "trade_name", "lat", "lon", "area_id", "vendor_id", "supervisor_id")
    named = clients.join(kept_areas.select("area_id", "area_desc"), "area_id")

    partners = _named_partners(customers, limit)
    vendors = partners.select(F.col("partner_id").alias("vendor_id"), F.col("partner_name").alias("vendor_name"))
    supervisors = partners.select(F.col("partner_id").alias("supervisor_id"), F.col("partner_name").alias("supervisor"))
    master = (
        named.join(vendors, "vendor_id", "left")
        .join(supervisors, "supervisor_id", "left")
        .withColumn("supervisor", F.coalesce("supervisor", F.lit(NO_SUPERVISOR)))
    )
    columns = ["trade_name", "lat", "lon", "area_desc", "vendor_id", "vendor_name", "supervisor"]
    if not extended:
        return master.select(key_text(F.col("customer_id")).alias("customer_id"), *columns)
    enriched = enrich_networks(master, networks, limit)
    return enriched.select(
        key_text(F.col("customer_id")).alias("customer_id"),
        *columns,
        region(F.col("area_desc")).alias("region"),
        "network",
        "subnetwork",
    )


def _named_partners(customers: DataFrame, limit: int) -> DataFrame:
    """Names of the partners that are some customer's vendor or supervisor.

    A small table is broadcast as it is. From a large one only the referenced partners are kept and
    written: they are few, because many customers share a vendor, so that the two joins need not
    shuffle the customers by the key that a single vendor may dominate.
    """
    partners = customers.select(F.col("customer_id").alias("partner_id"), F.col("person_name").alias("partner_name"))
    if measured_bytes(partners) <= limit:
        return F.broadcast(partners)
    referenced = customers.select(F.explode(F.array("vendor_id", "supervisor_id")).alias("partner_id")).distinct()
    kept = Scratch(customers.sparkSession, "partners").save(partners.join(referenced, "partner_id", "left_semi"), "kept")
    return broadcast_checked(kept, limit)


def centroid(master: DataFrame) -> DataFrame:
    return master.agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


def region_counts(master: DataFrame) -> DataFrame:
    """Markers per region."""
    return master.groupBy("region").agg(F.count(F.lit(1)).alias("markers"))


def master_summary(master: DataFrame) -> DataFrame:
    """Number of markers on the map."""
    return master.agg(F.count(F.lit(1)).alias("markers"))
