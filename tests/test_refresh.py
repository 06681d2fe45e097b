"""Written reports and the stream that keeps them up to date."""

from datetime import date, datetime

import pytest

from stopwise.operators.calendar import Calendar
from stopwise.plans.scenarios import SCENARIOS, scenario
from stopwise.schemas import CUSTOMERS, DELIVERIES, DRIVERS
from stopwise.sources import snapshots
from stopwise.sources.sinks import read_report, report_table, write_report
from stopwise.streaming.refresh import refresh_stream, touched_days


def day(d, hour=8):
    return datetime(2024, 6, d, hour)


FIRST = [(1, 1, 38, 1, 1, day(10), 1.0, 1.0), (2, 2, 38, 1, 1, day(11), 2.0, 2.0), (3, 3, 38, 1, 1, day(28), 3.0, 3.0)]
SECOND = [(4, 1, 38, 1, 1, day(10, 6), 9.0, 9.0), (5, 4, 38, 1, 1, day(12), 4.0, 4.0)]


def dimensions(spark):
    customers = [(c, f"C{c}", "", "-3.5", "-38.5", 1, 1, "1", 0, 1, 1, 2) for c in range(1, 6)]
    return {
        "customers": spark.createDataFrame(customers, CUSTOMERS),
        "drivers": spark.createDataFrame([(1, "D1")], DRIVERS),
    }


def test_written_days_replace_themselves_only(spark, tmp_path):
    path = str(tmp_path / "report")
    tables = dimensions(spark)
    for rows, days in ((FIRST, (day(10), day(11))), (SECOND, (day(10),))):
        deliveries = spark.createDataFrame(rows, DELIVERIES)
        calendar = Calendar.of(spark, *[d.date() for d in days])
        report = scenario("same_day_by_driver", deliveries, calendar=calendar, **tables)
        write_report(report, path, "same_day_by_driver")
    found = {(r.as_of.day, r.customer_id, r.weight_kg) for r in read_report(spark, path, "same_day_by_driver").collect()}
    assert found == {(10, 1, 9.0), (11, 2, 2.0)}


def run_stream(spark, root, name):
    source = spark.readStream.schema(DELIVERIES).parquet(f"{root}/arrivals")
    query = refresh_stream(
        source,
        dimensions(spark),
        name,
        f"{root}/store",
        f"{root}/report",
        f"{root}/checkpoint",
        trigger={"availableNow": True},
    )
    query.awaitTermination()


def test_second_run_rewrites_touched_days_only_and_equals_the_batch(spark, tmp_path):
    name, root = "six_day_by_date", str(tmp_path)
    files = {}
    for rows in (FIRST, SECOND):
        spark.createDataFrame(rows, DELIVERIES).coalesce(1).write.mode("append").parquet(f"{root}/arrivals")
        run_stream(spark, root, name)
        files[len(files)] = {d.day: s for d, s in report_table(spark, f"{root}/report", name).days().items()}
    rewritten = {d for d in files[1] if files[1][d] != files[0].get(d)}
    assert rewritten == set(range(5, 13))
    assert set(files[0]) - rewritten == set(range(23, 29))

    whole = scenario(
        name,
        spark.createDataFrame(FIRST + SECOND, DELIVERIES),
        calendar=Calendar.span(spark, day(1).date(), day(30).date()),
        **dimensions(spark),
    )
    streamed = read_report(spark, f"{root}/report", name).select(whole.columns)
    assert streamed.exceptAll(whole).isEmpty() and whole.exceptAll(streamed).isEmpty()


def test_touched_days_hold_every_day_that_changes(spark):
    # Every day of a departure's surroundings on which a scenario reports it must be touched.
    tables = dimensions(spark)
    span = Calendar.span(spark, day(1).date(), day(30).date())
    areas = spark.createDataFrame([], "area_id long, area_desc string")
    for name, spec in SCENARIOS.items():
        for d in range(9, 17):
            one = spark.createDataFrame([(1, 1, spec.ops[0], 1, 1, day(d), 1.0, 1.0)], DELIVERIES)
            reported = scenario(name, one, calendar=span, areas=areas, **tables).select("as_of")
            assert reported.exceptAll(touched_days(one, name)).isEmpty(), (name, d)


def test_a_day_without_rows_is_emptied(spark, tmp_path):
    path, tables = str(tmp_path / "report"), dimensions(spark)
    calendar = Calendar.of(spark, day(10).date(), day(11).date())
    for rows in (FIRST, FIRST[:1]):
        report = scenario("same_day_by_driver", spark.createDataFrame(rows, DELIVERIES), calendar=calendar, **tables)
        write_report(report, path, "same_day_by_driver", calendar.days)
    assert [(r.as_of.day, r.customer_id) for r in read_report(spark, path, "same_day_by_driver").collect()] == [(10, 1)]


CHANGES = [
    (1, 1, 38, 1, 1, day(10), 1.0, 1.0),  # as before
    (2, 2, 38, 4, 1, day(11), 2.0, 2.0),  # of a status that is not reported
    (3, 3, 38, 1, 1, datetime(2024, 7, 2, 8), 3.0, 3.0),  # moved to another month
    (6, 5, 38, 1, 1, day(12), 5.0, 5.0),
    (6, 5, 38, 1, 1, day(12), 5.0, 5.0),  # twice in one batch
]


def test_changed_and_repeated_deliveries_replace_themselves(spark, tmp_path):
    name, root = "six_day_by_date", str(tmp_path)
    back = [(3, 3, 38, 1, 1, day(28), 4.0, 3.0)]
    known = {}
    for rows in (FIRST, CHANGES, back):
        spark.createDataFrame(rows, DELIVERIES).coalesce(1).write.mode("append").parquet(f"{root}/arrivals")
        run_stream(spark, root, name)
        known.update({r[0]: r for r in rows})
        span = Calendar.span(spark, day(1).date(), datetime(2024, 7, 10).date())
        whole = scenario(name, spark.createDataFrame(list(known.values()), DELIVERIES), calendar=span, **dimensions(spark))
        streamed = read_report(spark, f"{root}/report", name).select(whole.columns)
        assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, whole.collect()))


VERSIONED = DELIVERIES.simpleString()[len("struct<") : -1].replace(":", " ") + ", version int"


def feed(spark, root, batches, **how):
    """Let every list of rows arrive as a batch of its own; the rows of the report, and what the state took in."""
    for rows in batches:
        spark.createDataFrame(rows, VERSIONED).coalesce(1).write.mode("append").parquet(f"{root}/arrivals")
    source = spark.readStream.schema(VERSIONED).option("maxFilesPerTrigger", 1).parquet(f"{root}/arrivals")
    query = refresh_stream(
        source,
        dimensions(spark),
        "same_day_by_driver",
        f"{root}/store",
        f"{root}/report",
        f"{root}/checkpoint",
        trigger={"availableNow": True},
        **how,
    )
    query.awaitTermination()
    found = read_report(spark, f"{root}/report", "same_day_by_driver")
    updated = [sum(s["numRowsUpdated"] for s in p["stateOperators"]) for p in query.recentProgress if p["numInputRows"]]
    return sorted(tuple(r) for r in found.collect()), updated


def test_any_split_into_batches_gives_the_same_report(spark, tmp_path):
    """Versions that move, stop and repeat deliveries, arriving in order, out of order and all at once."""
    rows = []
    for i in range(60):
        first = day(3 + i % 20, 6 + i % 12)
        rows.append((i, 1 + i % 5, 38, 1, 1, first, 1.0 + i, 1.0, 1))
        if i % 3 == 0:
            rows.append((i, 1 + i % 5, 38, 1, 1, day(3 + (i * 7) % 20, 5), 2.0 + i, 1.0, 2))
        if i % 6 == 0:
            rows.append((i, 1 + i % 5, 38, 4 if i % 4 == 0 else 1, 1, first, 3.0 + i, 1.0, 3))
        if i % 10 == 0:
            rows.append((i, 1 + i % 5, 38, 1, 1, None, 3.0 + i, 1.0, 4))
    shuffled = sorted(rows, key=lambda r: hash((r[0] * 7919 + r[-1] * 104729) % 1009))
    splits = {"once": [rows], "twenty": [rows[k::20] for k in range(20)], "late": [shuffled[k::3] for k in range(3)]}
    found = {k: feed(spark, str(tmp_path / k), batches, version="version") for k, batches in splits.items()}
    latest = {r[0]: r[:-1] for r in sorted(rows, key=lambda r: r[-1])}
    deliveries = spark.createDataFrame([r for r in latest.values() if r[5]], DELIVERIES)
    span = Calendar.span(spark, day(1).date(), day(30).date())
    whole = scenario("same_day_by_driver", deliveries, calendar=span, **dimensions(spark))
    expected = sorted(tuple(r) for r in whole.collect())
    assert {k: report for k, (report, _) in found.items()} == dict.fromkeys(splits, expected)
    # The state is asked for the deliveries of the batch only.
    assert found["twenty"][1] == [len({r[0] for r in batch}) for batch in splits["twenty"]]


def test_without_version_the_last_arrival_counts(spark, tmp_path):
    batches = [[(1, 1, 38, 1, 1, day(d), float(d), 1.0, 9 - d)] for d in (6, 8, 4)]
    report, _ = feed(spark, str(tmp_path), batches)
    assert [(r[0].day, r[-2]) for r in report] == [(4, 4.0)]


def test_deliveries_without_id_all_stay(spark, tmp_path):
    same = (None, 1, 38, 1, 1, day(6), 2.0, 1.0, 1)
    report, _ = feed(spark, str(tmp_path), [[same, same], [same, (5, 1, 38, 1, 1, day(6), 3.0, 1.0, 1)]], version="version")
    assert [(r[0].day, r[-2]) for r in report] == [(6, 9.0)]


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path, monkeypatch):
    """The first run of the second batch fails after the store, and again between rows and log of the report."""
    first = [(i, i, 38, 1, 1, day(5 + i), 1.0 * i, 1.0, 1) for i in range(1, 5)]
    second = [(2, 2, 38, 1, 1, day(6), 7.0, 1.0, 2), (None, 1, 38, 1, 1, day(9), 2.0, 1.0, 1)]
    root = str(tmp_path)
    before, _ = feed(spark, root, [first], version="version")
    publish = snapshots.DayTable._publish

    def fail(table, *args):
        if table.day == "as_of":
            raise RuntimeError("stopped before the log is written")
        publish(table, *args)

    monkeypatch.setattr(snapshots.DayTable, "_publish", fail)
    for again in ([second], []):
        with pytest.raises(Exception, match="stopped before"):
            feed(spark, root, again, version="version")
        left = read_report(spark, f"{root}/report", "same_day_by_driver")
        assert sorted(map(tuple, left.collect())) == before
    monkeypatch.undo()
    report, _ = feed(spark, root, [], version="version")
    # The eighth is a Saturday, which reports Monday.
    assert {(r[0].day, r[2], r[-2]) for r in report} == {(6, 1, 1.0), (6, 2, 7.0), (9, 1, 2.0), (9, 4, 4.0)}


def test_replaced_days_appear_at_once(spark, tmp_path, monkeypatch):
    table = snapshots.DayTable(spark, str(tmp_path / "t"), "d")

    def rows(*pairs):
        return spark.createDataFrame([(date(2024, 1, d), v) for d, v in pairs], "d date, v int")

    def kept(**bounds):
        return sorted((r.d.day, r.v) for r in table.read(**bounds).collect())

    with pytest.raises(ValueError, match="nothing was written"):
        table.read()
    assert table.read(rows().schema).isEmpty() and table.superseded() == []
    table.replace(rows((1, 1), (1, 2), (2, 3)))
    reader = table.read()
    monkeypatch.setattr(snapshots.DayTable, "_publish", lambda *_: (_ for _ in ()).throw(OSError("no space")))
    with pytest.raises(OSError):
        table.replace(rows((1, 9), (3, 9)), [date(2024, 1, 1), date(2024, 1, 2), date(2024, 1, 3)])
    assert kept() == [(1, 1), (1, 2), (2, 3)]
    monkeypatch.undo()
    # The second day is emptied, the rows of a day that is not named are not read.
    table.replace(rows((1, 7), (3, 8), (4, 9)), [date(2024, 1, d) for d in (1, 2, 3)])
    assert kept() == [(1, 7), (3, 8)] == kept(schema=rows().schema)
    assert sorted((r.d.day, r.v) for r in reader.collect()) == [(1, 1), (1, 2), (2, 3)]  # as it was then
    assert kept(first=date(2024, 1, 2)) == [(3, 8)] and kept(last=date(2024, 1, 2)) == [(1, 7)]
    assert kept(only=[date(2024, 1, 1), date(2024, 1, 9)]) == [(1, 7)] and kept(only=[]) == []
    assert len(table.superseded()) == 1


def test_the_log_is_begun_anew(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "COMPACT_AFTER", 3)
    table = snapshots.DayTable(spark, str(tmp_path), "d")
    for i in range(8):
        table.replace(spark.createDataFrame([(date(2024, 1, 1 + i % 3), i)], "d date, v int"))
    assert sorted((r.d.day, r.v) for r in table.read().collect()) == [(1, 6), (2, 7), (3, 5)]
    files = sorted(p.parent.name for p in tmp_path.glob("log/*/*.parquet"))
    assert files == ["epoch=0"] * 3 + ["epoch=1"] * 3 + ["epoch=2"] * 2
