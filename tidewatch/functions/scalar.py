"""Column helpers: local time, severities, priorities and number texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch import fixed


def local_to_utc(day: Column, minutes: Column, tz: Column) -> Column:
    """Wall clock ``minutes`` after midnight of ``day`` in ``tz`` as an instant (session zone UTC)."""
    wall = F.timestamp_seconds(F.unix_date(day).cast("long") * 86400 + minutes.cast("long") * 60)
    return F.to_utc_timestamp(wall, tz)


def local_time(ts: Column, tz: Column) -> Column:
    return F.from_utc_timestamp(ts, tz)


def local_date(ts: Column, tz: Column) -> Column:
    return F.to_date(local_time(ts, tz))


def local_minutes(ts: Column, tz: Column) -> Column:
    wall = local_time(ts, tz)
    return F.hour(wall) * 60 + F.minute(wall)


def iso_weekday(day: Column) -> Column:
    return F.weekday(day) + 1


def severity_rank(severity: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, rank in fixed.SEVERITY_RANK.items():
        out = F.when(severity == name, rank).otherwise(out)
    return out


def severity_name(rank: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, value in fixed.SEVERITY_RANK.items():
        out = F.when(rank == value, name).otherwise(out)
    return out


def priority(severity: Column, tier: Column, customers: Column) -> Column:
    big = F.coalesce(customers, F.lit(0.0)) >= fixed.P1_CUSTOMERS
    return (
        F.when(severity == "CRITICAL", F.when((tier == 1) | big, "P1").otherwise("P2"))
        .when(severity == "WARNING", F.when((tier == 1) & big, "P2").otherwise("P3"))
        .otherwise("P4")
    )


def demote(prio: Column) -> Column:
    rank = F.substring(prio, 2, 1).cast("int")
    return F.concat(F.lit("P"), F.least(F.lit(4), rank + 1).cast("string"))


def unit_scale_factor(ratio: Column) -> Column:
    """The first listed factor the ratio lies near, or null."""
    out = F.lit(None).cast("double")
    for factor in reversed(fixed.UNIT_FACTORS):
        near = F.abs(ratio / F.lit(factor) - 1) <= fixed.UNIT_TOLERANCE
        out = F.when((ratio > 0) & near, F.lit(factor)).otherwise(out)
    return out


def median_of(s: Column) -> Column:
    """Median of a sorted array column without nulls; null when empty."""
    n = F.size(s)
    hi = F.get(s, (n / 2).cast("int"))
    lo = F.get(s, ((n - 1) / 2).cast("int"))
    return F.when(n > 0, (lo + hi) / 2)


def quantile_of(s: Column, p: float) -> Column:
    """Linear-interpolated quantile of a sorted array column without nulls."""
    n = F.size(s)
    h = (n - 1) * F.lit(p)
    lo = F.floor(h).cast("int")
    hi = F.least(n - 1, lo + 1)
    a, b = F.get(s, lo), F.get(s, hi)
    return F.when(n > 0, a + (b - a) * (h - lo))


# --- texts in Turkish notation ---------------------------------------------------------------------


def num(v: Column, digits: int = 0) -> Column:
    return F.translate(F.format_number(v.cast("double"), digits), ",.", ".,")


def money(v: Column) -> Column:
    return F.concat(F.when(F.abs(v) < 1000, num(v, 2)).otherwise(num(v, 0)), F.lit(" TL"))


def pct(v: Column, digits: int = 0) -> Column:
    return F.concat(F.lit("%"), num(v * 100, digits))


def metric_value(metric: Column, v: Column) -> Column:
    return (
        F.when(metric.isin(fixed.MONEY_METRICS), money(v))
        .when(metric.isin(fixed.RATIO_METRICS), pct(v, 1))
        .otherwise(num(v))
    )


def lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), key)


def hhmm(minutes: Column) -> Column:
    m = F.bround(minutes.cast("double"), 0).cast("int")
    return F.format_string("%02d:%02d", (m / 60).cast("int"), m % 60)


def duration(minutes: Column) -> Column:
    m = F.bround(minutes.cast("double"), 0).cast("int")
    h, r = F.floor(m / 60).cast("int"), m % 60
    d, hh = F.floor(h / 24).cast("int"), h % 24
    return (
        F.when(m < 60, F.format_string("%d dk", m))
        .when((h < 24) & (r > 0), F.format_string("%d sa %d dk", h, r))
        .when(h < 24, F.format_string("%d sa", h))
        .when(hh > 0, F.format_string("%d gün %d sa", d, hh))
        .otherwise(F.format_string("%d gün", d))
    )
