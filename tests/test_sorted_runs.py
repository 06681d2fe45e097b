"""Positions in sorted runs against sorting all values."""

import random

import pytest
from pyspark.sql import functions as F

from stopwise.operators.facets import facet_values
from stopwise.operators.sorted_runs import SortedRuns


def full_sort(spark, pairs):
    """Positions by ``facet_values``, over a master that has the values of two facets."""
    rows = [(v if f == "id" else None, v if f == "customer" else None) for f, v in pairs]
    master = spark.createDataFrame(rows, "customer_id string, trade_name string")
    return sorted(tuple(r) for r in facet_values(master, 10_000).collect())


def kept(runs):
    return sorted(tuple(r) for r in runs.values().select("facet", "value", "position").collect())


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "facet string, value string")


@pytest.mark.parametrize("run_rows", [1, 7, 1_000])
def test_added_values_have_the_positions_of_a_full_sort(spark, tmp_path, run_rows):
    draw = random.Random(run_rows)
    runs, all_pairs = SortedRuns(spark, str(tmp_path / "runs"), run_rows), []
    assert kept(runs) == []
    for size in (25, 1, 30):
        pairs = [("id", str(draw.randrange(200))) for _ in range(size)]
        pairs += [("customer", draw.choice("aAbBéZz") + str(draw.randrange(60))) for _ in range(size)]
        runs.add(frame(spark, [*pairs, (None, "x"), ("id", None)]))
        all_pairs += pairs
        assert kept(runs) == full_sort(spark, all_pairs)
    # The first value that is no number turns the order of its facet.
    runs.add(frame(spark, [("id", "12b")]))
    assert kept(runs) == full_sort(spark, [*all_pairs, ("id", "12b")])
    runs.add(frame(spark, [("id", "7")]))
    assert kept(runs) == full_sort(spark, [*all_pairs, ("id", "12b"), ("id", "7")])


def test_only_the_runs_that_values_fall_in_are_read_and_written(spark, tmp_path, monkeypatch):
    runs = SortedRuns(spark, str(tmp_path / "runs"), 50)
    runs.add(frame(spark, [("id", str(10 * i)) for i in range(1_000)]))
    before = {(r.run, r.folder): r.rows for r in runs.runs().collect()}
    assert len(before) == 20 and set(before.values()) == {50}
    read = []
    plain = SortedRuns._read

    def watched(self, some):
        read.append(some.select(F.sum("rows")).first()[0])
        return plain(self, some)

    monkeypatch.setattr(SortedRuns, "_read", watched)
    runs.add(frame(spark, [("id", "15"), ("id", "16"), ("id", "5005"), ("id", "20")]))
    assert read == [100]  # two runs of fifty
    after = {(r.run, r.folder): r.rows for r in runs.runs().collect()}
    assert len(set(before) & set(after)) == 18 and sum(after.values()) == 1_003
    # Values that are there already write nothing.
    runs.add(frame(spark, [("id", "15"), ("id", "9990")]))
    assert {(r.run, r.folder): r.rows for r in runs.runs().collect()} == after
    monkeypatch.undo()
    position = {r.value: r.position for r in runs.values().collect()}
    assert (position["10"], position["15"], position["16"], position["20"]) == (2, 3, 4, 5)
    assert (position["5000"], position["5005"], position["9990"]) == (503, 504, 1_003)
