from datetime import date, datetime

from pyspark.sql import functions as F

from build import contract, contracts, slot
from tidewatch.operators.contracts import contract_validity
from tidewatch.operators.schedule import expand_schedule


def test_days_and_phases(tr_calendar):
    rows = {r["day"]: r for r in tr_calendar.filter("day between '2026-03-01' and '2027-06-30'").collect()}
    for d in (date(2026, 10, 29), date(2026, 3, 20), date(2026, 5, 28)):
        assert not rows[d]["is_business_day"]
    assert rows[date(2026, 10, 28)]["is_business_day"] and rows[date(2026, 10, 28)]["is_half_day"]
    assert [rows[date(2026, 9, d)]["month_phase"] for d in (1, 15, 30)] == ["START", "MID", "END"]
    # 19 May 2027 is a national and a religious day at once: the full day wins.
    assert not rows[date(2027, 5, 19)]["is_business_day"]
    assert rows[date(2026, 10, 29)]["next_bd"] == date(2026, 10, 30) and rows[date(2026, 10, 29)]["prev_bd"] == date(2026, 10, 28)


def test_cadences_and_shifts(spark, tr_calendar):
    monthly = [
        contract(s, [slot("m", "MONTHLY", month_days=[29], shift=s)])
        for s in ("NEXT_BUSINESS_DAY", "PREVIOUS_BUSINESS_DAY", "NONE", "SKIP")
    ]
    more = [
        contract("daily"),
        contract("collapse", [slot("m", "MONTHLY", month_days=[30, 31], last=True, shift="PREVIOUS_BUSINESS_DAY")]),
        contract("weekly", [slot("w", "WEEKLY", weekdays=[4, 7], shift="NEXT_BUSINESS_DAY")]),
    ]
    e = expand_schedule(contracts(spark, monthly + more), tr_calendar, date(2026, 10, 1), date(2026, 11, 1)).collect()
    by = lambda i: sorted(r["business_date"] for r in e if r["institution"] == i)
    assert by("NEXT_BUSINESS_DAY") == [date(2026, 10, 30)]
    assert by("PREVIOUS_BUSINESS_DAY") == [date(2026, 10, 28)]
    assert by("NONE") == [date(2026, 10, 29)]
    assert by("SKIP") == []
    assert [d for d in by("daily") if d >= date(2026, 10, 26)] == [date(2026, 10, d) for d in (26, 27, 28, 30)]
    # 30th, 31st (moved back) and the last business day are one delivery; the 30th generated it first.
    got = [r for r in e if r["institution"] == "collapse"]
    assert [(r["business_date"], r["nominal_date"]) for r in got] == [(date(2026, 10, 30), date(2026, 10, 30))]
    # Thursday 29 October is a holiday and Sundays move on: Friday and Mondays.
    assert by("weekly")[-2:] == [date(2026, 10, 26), date(2026, 10, 30)]
    one = [r for r in e if r["institution"] == "daily" and r["business_date"] == date(2026, 10, 5)][0]
    assert one["deadline_utc"] == datetime(2026, 10, 5, 7, 0) and one["window_start_utc"] == datetime(2026, 10, 5, 3, 0)


def test_clock_change(spark, tr_calendar):
    c = contracts(spark, [contract("b", [slot("d", "EVERY_DAY", start=150, deadline=600)], tz="Europe/Berlin")])
    e = expand_schedule(c, tr_calendar, date(2024, 3, 30), date(2024, 10, 28))
    got = {r["business_date"]: r["window_start_utc"] for r in e.collect()}
    assert got[date(2024, 3, 31)] == datetime(2024, 3, 31, 1, 30)  # 02:30 does not exist
    assert got[date(2024, 10, 27)] == datetime(2024, 10, 27, 0, 30)  # 02:30 exists twice, the first counts


def test_validity(spark):
    rows = [
        contract("a", version=1, start=date(2026, 1, 1)),
        contract("a", version=2, start=date(2026, 6, 1)),
        contract("a", version=3, start=date(2026, 6, 1)),
        contract("a", version=4, start=date(2026, 7, 1), status="PENDING"),
    ]
    v = contract_validity(contracts(spark, rows)).select("version", "valid_from", "valid_to").orderBy("valid_from").collect()
    assert [tuple(r) for r in v] == [(1, date(2026, 1, 1), date(2026, 6, 1)), (3, date(2026, 6, 1), None)]
    assert F is not None
