"""As-of attributes and snapshot differences against hand-made cases."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from tenure.functions.text import fold
from tenure.operators.asof import known_at_event
from tenure.operators.snapshots import change_events, validity_intervals

CHANGES = "metro_id string, parcel_id string, snapshot_date date, retrieved_at timestamp_ntz, building_type string, doc_id string, __at int"


def as_of(spark, events, changes):
    e = spark.createDataFrame(events, "metro_id string, doc_id string, parcel_id string, recorded_date date, building_type string")
    c = spark.createDataFrame([(*x, "clash", 1) for x in changes], CHANGES)
    key = ["metro_id", "parcel_id"]
    out = known_at_event(e.drop("building_type"), key, "recorded_date", c, key, "snapshot_date", F.to_date("retrieved_at"), ["snapshot_date", "retrieved_at"], ["building_type"])
    return sorted([(r["doc_id"], r["parcel_id"], r["building_type"]) for r in out.collect()], key=repr)


def test_only_what_was_known(spark):
    changes = [
        ("m", "p", date(2020, 1, 1), datetime(2020, 1, 5), "old"),
        ("m", "p", date(2021, 1, 1), datetime(2021, 6, 1, 12), "new"),
        ("m", "p", date(2020, 1, 1), datetime(2021, 7, 1), "late correction of the old"),
    ]
    events = [("m", "d0", "p", date(2020, 1, 4), ""), ("m", "d1", "p", date(2020, 1, 5), ""), ("m", "d2", "p", date(2021, 5, 31), ""), ("m", "d3", "p", date(2021, 6, 1), ""), ("m", "d4", "p", date(2022, 1, 1), ""), ("x", "d5", "p", date(2022, 1, 1), "")]
    assert as_of(spark, events, changes) == [("d1", "p", "old"), ("d2", "p", "old"), ("d3", "p", "new"), ("d4", "p", "new")]


def test_nulls_ties_repeats(spark):
    changes = [("m", "p", date(2020, 1, 1), datetime(2020, 1, 1), "b"), ("m", "p", date(2020, 1, 1), datetime(2020, 1, 1), "a"), ("m", "p", date(2020, 1, 1), datetime(2020, 1, 1), "a"), ("m", None, date(2020, 1, 1), datetime(2020, 1, 1), "z"), ("m", "q", None, datetime(2020, 1, 1), "z"), ("m", "r", date(2020, 1, 1), None, "z"), ("m", "s", date(2020, 1, 1), datetime(2020, 1, 1), None)]
    day = date(2021, 1, 1)
    events = [("m", "d", "p", day, ""), ("m", "d", "p", day, ""), ("m", "d", None, day, ""), ("m", "d", "q", day, ""), ("m", "d", "r", day, ""), ("m", "e", "p", None, ""), ("m", "d", "s", day, "")]
    assert as_of(spark, events, changes) == [("d", "p", "b"), ("d", "p", "b"), ("d", "s", None)]


def test_empty_sides(spark):
    assert as_of(spark, [], [("m", "p", date(2020, 1, 1), datetime(2020, 1, 1), "b")]) == []
    assert as_of(spark, [("m", "d", "p", date(2020, 1, 1), "")], []) == []


def diff(spark, rows):
    df = spark.createDataFrame(rows, "metro_id string, parcel_id string, snapshot_date date, v int, owner string, no int, k string")
    events = change_events(validity_intervals(df, "metro_id", "parcel_id", "snapshot_date", "v", {"owner": fold(F.col("owner"))}), "metro_id", "parcel_id", "snapshot_date")
    return sorted((r["parcel_id"], str(r["snapshot_date"]), r["change_kind"]) for r in events.collect())


def test_changes(spark):
    d = [date(2020, 1, 1), date(2021, 1, 1), date(2022, 1, 1), date(2023, 1, 1)]
    rows = [("m", "all", x, 1, "A", 0, "") for x in d]
    rows += [("m", "leaves", d[0], 1, "A", 0, ""), ("m", "comes", d[2], 1, "A", 0, ""), ("m", "comes", d[3], 1, " a  ", 0, "")]
    rows += [("m", "returns", d[0], 1, "A", 0, ""), ("m", "returns", d[2], 1, "A", 0, ""), ("m", "returns", d[3], 1, "B", 0, "")]
    rows += [("m", "corrected", d[0], 1, "A", 0, ""), ("m", "corrected", d[1], 1, "X", 0, ""), ("m", "corrected", d[1], 2, "A", 0, ""), ("m", "corrected", d[2], 1, None, 0, ""), ("m", "corrected", d[3], 1, " ", 0, "")]
    rows += [("m", None, d[0], 1, "A", 0, ""), (None, "p", d[0], 1, "A", 0, ""), ("m", "p", None, 1, "A", 0, "")]
    assert diff(spark, rows + rows) == [
        ("comes", "2022-01-01", "added"), ("corrected", "2022-01-01", "changed"), ("leaves", "2021-01-01", "removed"),
        ("returns", "2021-01-01", "removed"), ("returns", "2022-01-01", "added"), ("returns", "2023-01-01", "changed"),
    ]


def test_groups_have_their_own_dates(spark):
    rows = [("m", "p", date(2020, 1, 1), 1, "A", 0, ""), ("m", "p", date(2022, 1, 1), 1, "A", 0, ""), ("n", "q", date(2020, 1, 1), 1, "A", 0, ""), ("n", "p", date(2021, 1, 1), 1, "A", 0, "")]
    assert diff(spark, rows) == [("p", "2021-01-01", "added"), ("q", "2021-01-01", "removed")]


def test_no_rows(spark):
    assert diff(spark, []) == []
