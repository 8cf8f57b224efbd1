"""Deliveries that no contract version covers, and shifted days beyond the calendar."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from build import contract, contracts, load, loads, slot, utc
from tidewatch.operators.evaluate import evaluate
from tidewatch.operators.replay import replay_occurrences
from tidewatch.operators.schedule import expand_schedule


def test_delivery_before_the_first_version_stays(spark, tr_calendar):
    days = [date(2026, 9, d) for d in (7, 8, 9, 10, 11)]
    rows = loads(spark, [load(k, "early", utc(d, 450)) for k, d in enumerate(days)])
    now = datetime(2026, 9, 11, 20)
    occ, _ = replay_occurrences(rows, contracts(spark, [contract("early")]), tr_calendar, days[0], days[-1], now)
    out = evaluate(occ, contracts(spark, [contract("early", start=days[3])]), F.lit(now)).orderBy("business_date").collect()
    assert [r["business_date"] for r in out] == days
    assert [r["contract_version"] for r in out] == [None] * 3 + [1] * 2
    assert all(r["status"] for r in out)


def test_shifted_day_beyond_the_calendar_is_an_error(spark, tr_calendar):
    # Sunday the 11th moves to Monday the 12th, which this calendar lacks
    short = tr_calendar.filter(F.col("day") != F.lit(date(2026, 10, 12)))
    c = contracts(spark, [contract("w", [slot("w", "WEEKLY", weekdays=[7], shift="NEXT_BUSINESS_DAY")])])
    with pytest.raises(Exception, match="does not cover TR on 2026-10-1"):
        expand_schedule(c, short, date(2026, 10, 6), date(2026, 10, 14)).collect()
