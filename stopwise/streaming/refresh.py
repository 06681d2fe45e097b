"""Reports that follow newly arriving deliveries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stopwise.functions.dates import week_start
from stopwise.operators.calendar import Calendar
from stopwise.plans.scenarios import find_scenario, scenario
from stopwise.sources.sinks import write_report
from stopwise.sources.snapshots import DayTable

EVERY = "5 minutes"
# The deliveries known are kept on disk; a batch adds its changes to the checkpoint, not all of them.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}

# No scenario looks further back or ahead of its report day than this many days.
LOOKS_BACK, LOOKS_AHEAD = 5, 7

def touched_days(arrived: DataFrame, name: str) -> DataFrame:
    """Report days whose rows may change because of these deliveries.

    A departure can matter to every report day that looks at it: those up to the window length
    before it, and for the Monday and Tuesday report those of the whole week around it.
    """
    spec = find_scenario(name)
    leaves = F.col("leaves")
    dates = arrived.select(F.col("departure_ts").cast("date").alias("leaves")).where("leaves is not null").distinct()
    if spec.window_days is not None:
        low, high = F.date_sub(leaves, spec.window_days), leaves
    elif spec.normal_days is not None:
        low, high = F.date_sub(leaves, 2), leaves
    else:
        low, high = week_start(leaves), F.date_add(week_start(leaves), 6)
    return dates.select(F.explode(F.sequence(low, high, F.expr("interval 1 day"))).alias("as_of")).distinct()


def latest_versions(arrived: DataFrame, key: str, departs: str, version: str | None) -> DataFrame:
    """The newest version of every delivery that arrives, with the dates on which any version of it left.

    Of a stream this is an aggregation whose state holds one row a delivery: a batch looks up and
    changes the deliveries it brings, however many came before. Versions are compared by ``version``,
    then departure, then all columns, so the same arrivals give the same result in whatever batches
    they come. Without ``version`` the time of the batch stands for it. Rows without key are passed on
    once, each a delivery of its own.
    """
    columns = [F.col(f"`{c}`") for c in arrived.columns]
    order = F.current_timestamp() if version is None else F.col(f"`{version}`")
    rows = arrived.select(
        F.col(f"`{key}`").alias("key"),
        F.struct(*columns).alias("row"),
        F.col(f"`{departs}`").alias("departs"),
        order.alias("version"),
    )
    leaves = F.col("departs").cast("date")
    keyed = rows.where("key is not null").groupBy("key").agg(
        F.max(F.struct("version", "departs", "row")).alias("newest"), F.collect_set(leaves).alias("dates")
    )
    keyed = keyed.select("key", "newest.row", "dates")
    loose = rows.where("key is null").select("key", "row", F.array_compact(F.array(leaves)).alias("dates"))
    return keyed.unionByName(loose)


def refresh_stream(
    deliveries: DataFrame,
    dimensions: dict[str, DataFrame],
    name: str,
    store: str,
    report: str,
    checkpoint: str,
    *,
    key: str = "delivery_id",
    departs: str = "departure_ts",
    version: str | None = None,
    within: Calendar | None = None,
    prepare: Callable[[DataFrame], DataFrame] = lambda df: df,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Keep a scenario report up to date with a stream of new and changed deliveries.

    ``key`` and ``departs`` are the arriving rows' delivery and departure columns, ``prepare`` makes
    deliveries of the rows. A delivery's newest version counts (see ``latest_versions``): with
    ``version``, a column that grows with every change of a delivery, late and repeated arrivals
    change nothing, and without it a later batch replaces what came before. Its state is kept by
    Spark in RocksDB, in as many partitions as shuffles have when the stream first starts.

    Each batch takes the newest versions of its deliveries, replaces the departure dates that any
    version of them was on in ``store``, and then the report days that look at these dates in
    ``report``, also those without rows left. Store and report are ``DayTable`` s, so a batch reads and
    writes the dates and days it touches, whatever the history, and a report is replaced as a whole.
    A batch that is run again after a failure gives the same rows. ``within`` limits the report to
    certain days. ``store`` and ``checkpoint`` belong together, and neither is shared by streams.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        changes = _written(batch, f"{store}/arriving/changes")
        # Dates of a calendar: at most one row for each.
        dates = sorted(r.date for r in changes.select(F.explode("dates").alias("date")).distinct().collect())
        if not dates:
            return
        rows = prepare(changes.select("row.*"))
        rows = rows.drop(version) if version and version in rows.columns else rows
        leaves = F.col("departure_ts").cast("date")
        rows = rows.withColumns({"departure_date": leaves, "batch": F.lit(batch_id).cast("long")})
        arrived = _written(rows, f"{store}/arriving/rows")

        stored = DayTable(spark, store, "departure_date")
        before = stored.read(arrived.schema, only=dates)
        # What the batch's deliveries were before it goes, and so do rows that this batch, run before, left.
        kept = before.where(F.col("delivery_id").isNotNull() | (F.col("batch") != batch_id)).join(
            changes.select(F.col("key").alias("delivery_id")), "delivery_id", "left_anti"
        )
        stored.replace(kept.select(arrived.columns).unionByName(arrived), dates)

        days = touched_days(_as_frame(spark, dates), name)
        if within is not None:
            days = days.join(within.days, "as_of", "left_semi")
        touched = [row.as_of for row in days.collect()]  # again of a calendar
        if touched:
            calendar = Calendar.of(spark, *touched)
            near = stored.read(
                arrived.schema, calendar.first - timedelta(LOOKS_BACK), calendar.last + timedelta(LOOKS_AHEAD)
            )
            fresh = scenario(name, near.drop("batch"), calendar=calendar, **dimensions)
            write_report(fresh, report, name, touched)

    newest = latest_versions(deliveries, key, departs, version)
    writer = newest.writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", checkpoint)
    with _settings(deliveries.sparkSession, STATE):
        return writer.trigger(**(trigger or {"processingTime": EVERY})).start()


def _written(rows: DataFrame, path: str) -> DataFrame:
    """The rows of a batch, which is read more than once; they take the place of those of the batch before."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _as_frame(spark: SparkSession, dates: list[date]) -> DataFrame:
    return spark.createDataFrame([(d,) for d in dates], "departure_ts date")


@contextmanager
def _settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings for a stream that is started meanwhile."""
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
