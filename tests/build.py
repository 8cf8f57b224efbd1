"""Small tables for tests."""

from datetime import date, datetime, timedelta

from tidewatch import schemas

TZ = "Europe/Istanbul"
OFFSET = timedelta(hours=3)


def utc(day: date, minutes: int) -> datetime:
    return datetime.combine(day, datetime.min.time()) + timedelta(minutes=minutes) - OFFSET


def slot(key="daily", cadence="BUSINESS_DAYS", weekdays=None, month_days=None, last=False, shift="NEXT_BUSINESS_DAY", start=360, deadline=600, grace=0):
    return (key, f"{key} dosya", cadence, weekdays, month_days, last, shift, start, deadline, grace)


QUALITY = (True, True, True, 0.05, 0.01, True, "INFO")


def contract(institution, slots=None, metrics=None, limits=None, quality=QUALITY, learning=(180, 8), version=1, start=date(2024, 1, 1), status="APPROVED", tz=TZ):
    metrics = [("record_count", "MEDIUM", "BOTH"), ("total_amount", "MEDIUM", "BOTH")] if metrics is None else metrics
    return (institution, version, status, start, tz, "TR", slots or [slot()], metrics, limits or [], quality, learning)


def contracts(spark, rows):
    return spark.createDataFrame(rows, schemas.CONTRACTS)


def load(n, institution, at, records=100000, amount=None, customers=None, zero=None, negative=0, duplicates=0, content=None, hint=None):
    from decimal import Decimal

    amount = records * 500 if amount is None else amount
    return (
        f"{institution}-L{n:05d}",
        institution,
        f"x{n}",
        at,
        content or f"hash-{institution}-{n}",
        hint,
        records,
        Decimal(amount).quantize(Decimal("0.01")),
        int(0.95 * records) if customers is None else customers,
        int(0.005 * records) if zero is None else zero,
        negative,
        duplicates,
        None,
        "SIM",
        None,
        at,
    )


def loads(spark, rows):
    return spark.createDataFrame(rows, schemas.LOADS)
