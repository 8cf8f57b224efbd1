"""Inputs that the named queries do not contain: composite keys, cleared values, ties, versions, repeated runs, short calendars."""

from datetime import UTC, date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from build import contract, contracts
from tidewatch.operators import incidents as I
from tidewatch.operators.calendar import calendar_dim
from tidewatch.operators.inference import infer_contracts
from tidewatch.operators.replay import warm_up
from tidewatch.operators.schedule import expand_schedule
from tidewatch.sources.loads import upsert_occurrences, upsert_shadow
from tidewatch.sources.records import summarize_records

KEYS = "institution STRING, slot_key STRING, business_date DATE"
DAY = date(2026, 9, 16)
NOW = datetime(2026, 9, 16, 9, 0, tzinfo=UTC)


def test_record_keys_are_columns(spark):
    rows = [("f", "c", "a|b", "c"), ("f", "c", "a", "b|c"), ("f", "c", None, "x"), ("f", "c", "x", None), ("g", "c", "a|b", "c"), ("g", "c", "a|b", "c")]
    rec = spark.createDataFrame(rows, "file STRING, customer STRING, k STRING, l STRING").withColumn("amount", F.lit(1))
    got = {r["file"]: r for r in summarize_records(rec, ["file"], "amount", "customer", ["k", "l"]).collect()}
    assert (got["f"]["record_count"], got["f"]["duplicate_record_count"]) == (4, 0)
    assert got["g"]["duplicate_record_count"] == 1
    one = [("p", "c", "a|b", "c"), ("q", "c", "a", "b|c"), ("r", "c", None, "x"), ("s", "c", "x", None), ("t", "c", "\\N", "x")]
    rec = spark.createDataFrame(one, "file STRING, customer STRING, k STRING, l STRING").withColumn("amount", F.lit(1))
    hashes = {r["content_hash"] for r in summarize_records(rec, ["file"], "amount", "customer", ["k", "l"]).collect()}
    assert len(hashes) == 5


def test_new_row_clears_a_value(spark):
    schema = f"{KEYS}, status STRING, max_severity STRING"
    old = spark.createDataFrame([("a", "d", DAY, "LATE", "WARNING"), ("b", "d", DAY, "LATE", "WARNING")], schema)
    new = spark.createDataFrame([("a", "d", DAY, "RECEIVED", None), ("c", "d", DAY, "PENDING", None)], schema)
    got = {r["institution"]: (r["status"], r["max_severity"]) for r in upsert_occurrences(old, new).collect()}
    assert got == {"a": ("RECEIVED", None), "b": ("LATE", "WARNING"), "c": ("PENDING", None)}


def test_equal_times_prefer_the_new_result(spark):
    schema = f"{KEYS}, challenger STRING, status STRING, evaluated_at TIMESTAMP"
    old = spark.createDataFrame([("a", "d", DAY, "x", "RECEIVED", NOW)], schema)
    new = spark.createDataFrame([("a", "d", DAY, "x", "LATE", NOW)], schema)
    assert [r["status"] for r in upsert_shadow(old, new).collect()] == ["LATE"]


def test_outage_is_grouped_once(spark):
    occ = spark.createDataFrame(
        [(f"i{i}", "daily", DAY, True, NOW - timedelta(minutes=30), "MISSING") for i in range(3)],
        f"{KEYS}, expected BOOLEAN, deadline_utc TIMESTAMP, status STRING",
    )
    inc = spark.createDataFrame(
        [(i, f"i{i}", "daily", DAY, "P2", "OPEN", None) for i in range(3)],
        f"incident_id LONG, {KEYS}, priority STRING, status STRING, parent_id LONG",
    )
    parent, linked = I.group_systemic(I.detect_systemic(occ, F.lit(NOW)), inc, occ, F.lit(NOW))
    (p,) = parent.collect()
    assert {(r["priority"], r["parent_id"]) for r in linked.collect()} == {("P3", p["incident_id"])}
    stored = linked.select(*inc.columns).unionByName(parent.select("incident_id", "priority", F.lit("OPEN").alias("status")), allowMissingColumns=True)
    again, twice = I.group_systemic(I.detect_systemic(occ, F.lit(NOW)), stored, occ, F.lit(NOW))
    assert again.count() == 0
    assert {r["priority"] for r in twice.filter("institution is not null").collect()} == {"P3"}
    assert twice.filter("linked").count() == 0


def test_calendar_without_holidays_and_short_calendar(spark):
    none = spark.createDataFrame([], "calendar STRING, day DATE, is_half_day BOOLEAN")
    c = contracts(spark, [contract("a")])
    cal = calendar_dim(spark, none, date(2026, 8, 1), date(2026, 10, 31), c)
    got = expand_schedule(c, cal, date(2026, 9, 14), date(2026, 9, 20))
    assert sorted(r["business_date"].day for r in got.collect()) == [14, 15, 16, 17, 18]
    with pytest.raises(Exception, match="does not cover"):
        expand_schedule(c, cal, date(2026, 9, 14), date(2026, 12, 20)).collect()


def test_a_removed_peak_removes_its_successors(spark, tr_calendar):
    rows = [("a", datetime(2026, m, d, 6, tzinfo=UTC)) for m in range(1, 13) for d in (1, 4, 7)]
    arrivals = spark.createDataFrame(rows, "institution STRING, received_at TIMESTAMP")
    (r,) = infer_contracts(arrivals, tr_calendar, "UTC", date(2026, 1, 1), date(2026, 12, 31)).collect()
    assert (r["cadence"], r["month_days"]) == ("MONTHLY", [1])


def test_warm_up_starts_with_the_first_load(spark):
    loads = spark.createDataFrame([(datetime(2026, 5, 1, tzinfo=UTC),), (NOW,)], "received_at TIMESTAMP")
    assert warm_up(loads, DAY, 400) == date(2026, 5, 1)
    assert warm_up(loads, DAY, 30) == DAY - timedelta(days=35)
    assert warm_up(loads.limit(0), DAY, 400) == DAY
