"""Contracts proposed from observed arrivals, for all senders at once."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import schemas
from tidewatch.functions.scalar import iso_weekday, local_date, local_minutes, pct
from tidewatch.operators.calendar import MAX_CALENDAR_ROWS
from tidewatch.session import broadcast_within

# Fixed values of the rules.
MIN_DAYS = 8
DAILY_COVERAGE = 0.85
WEEKDAY_COVERAGE, WEEKLY_SHARE = 0.7, 0.8
MONTH_DAY_SHARE, LAST_DAY_SHARE = 0.5, 0.6
PEAK_SPREAD = 3


def first_arrivals(arrivals: DataFrame, tz: str, start: date, end: date) -> DataFrame:
    """(institution, day, minutes): the first arrival per local day; combines map-side."""
    zone = F.lit(tz)
    return (
        arrivals.select("institution", "received_at", local_date(F.col("received_at"), zone).alias("day"))
        .filter(F.col("day").between(F.lit(start), F.lit(end)))
        .groupBy("institution", "day")
        .agg(F.min("received_at").alias("at"))
        .select("institution", "day", local_minutes(F.col("at"), zone).alias("minutes"))
    )


def infer_contracts(arrivals: DataFrame, cal: DataFrame, tz: str, start: date, end: date) -> DataFrame:
    """(institution, days, cadence, weekdays, month_days, last_business_day, window_start_min, deadline_min, confidence).

    After ``first_arrivals`` a sender has at most one row per day of the period, so every value below is
    an aggregate over a calendar-bounded group; day lists are arrays of at most 31 numbers.
    """
    dim = cal.filter(F.col("day").between(F.lit(start), F.lit(end)))
    dim = broadcast_within(dim.select("day", "is_business_day", "is_last_bd_of_month"), MAX_CALENDAR_ROWS)
    wd, dom = iso_weekday(F.col("day")), F.dayofmonth("day")
    days = first_arrivals(arrivals, tz, start, end).join(dim, "day")
    n_days = (end - start).days + 1
    # Calendar totals of the period, one row.
    totals = dim.agg(
        F.count_if("is_business_day").alias("bdays"),
        *[F.count_if(wd == i).alias(f"w{i}") for i in range(1, 8)],
        F.count_distinct(F.trunc("day", "month")).alias("months"),
    )
    t = totals.select(F.struct("*")).scalar()
    per = days.groupBy("institution").agg(
        F.count("*").alias("days"),
        F.count_if("is_business_day").alias("on_bd"),
        F.count_if("is_last_bd_of_month").alias("on_last"),
        F.percentile("minutes", F.array(F.lit(0.03), F.lit(0.5), F.lit(0.99))).alias("q"),
        F.array(*[F.count_if(wd == i) for i in range(1, 8)]).alias("by_wd"),
        F.array(*[F.count_if(dom == i) for i in range(1, 32)]).alias("by_dom"),
        # Last business days by day of month: days a monthly rule explains without a peak.
        F.array(*[F.count_if((dom == i) & F.col("is_last_bd_of_month")) for i in range(1, 32)]).alias("last_by_dom"),
    )
    p = per.withColumn("t", t)
    bd_cov = F.col("on_bd") / F.greatest("t.bdays", F.lit(1))
    off_cov = (F.col("days") - F.col("on_bd")) / F.greatest(F.lit(n_days) - F.col("t.bdays"), F.lit(1))
    weekly = F.array_compact(
        F.array(*[F.when(F.get("by_wd", F.lit(i - 1)) / F.greatest(F.col(f"t.w{i}"), F.lit(1)) >= WEEKDAY_COVERAGE, F.lit(i)) for i in range(1, 8)])
    )
    all_peaks = F.filter(F.sequence(F.lit(1), F.lit(31)), lambda d: F.get("by_dom", d - 1) >= MONTH_DAY_SHARE * F.col("t.months"))
    # A peak up to 3 days after another is the same delivery, shifted; that other need not be kept itself.
    kept = F.filter(all_peaks, lambda d: ~F.exists(all_peaks, lambda x: (d - x).between(1, PEAK_SPREAD)))
    p = p.withColumns({"bd_cov": bd_cov, "off_cov": off_cov, "wds": weekly, "peaks": kept})
    share = F.aggregate("wds", F.lit(0).cast("bigint"), lambda acc, w: acc + F.get("by_wd", w - 1)) / F.col("days")
    use_last = F.col("on_last") >= LAST_DAY_SHARE * F.col("t.months")
    p = p.withColumns({"weekly_share": share, "use_last": use_last})
    cadence = (
        F.when(F.col("days") < MIN_DAYS, F.lit(None))
        .when(bd_cov >= DAILY_COVERAGE, F.when(F.col("off_cov") >= DAILY_COVERAGE, "EVERY_DAY").otherwise("BUSINESS_DAYS"))
        .when((F.size("wds") > 0) & (F.col("weekly_share") >= WEEKLY_SHARE), "WEEKLY")
        .when((F.size("peaks") > 0) | F.col("use_last"), "MONTHLY")
    )
    p = p.withColumn("cadence", cadence)
    near_peak = lambda d: F.exists("peaks", lambda x: (d - x >= 0) & (d - x <= PEAK_SPREAD))
    monthly_hits = F.aggregate(
        F.sequence(F.lit(1), F.lit(31)),
        F.lit(0).cast("bigint"),
        lambda acc, d: acc
        + F.when(near_peak(d), F.get("by_dom", d - 1)).when(F.col("use_last"), F.get("last_by_dom", d - 1)).otherwise(F.lit(0).cast("bigint")),
    )
    explained = (
        F.when(F.col("cadence") == "EVERY_DAY", F.col("days"))
        .when(F.col("cadence") == "BUSINESS_DAYS", F.col("on_bd"))
        .when(F.col("cadence") == "WEEKLY", F.bround(F.col("weekly_share") * F.col("days"), 0).cast("bigint"))
        .when(F.col("cadence") == "MONTHLY", monthly_hits)
    )
    day_cap = 23 * 60 + 59
    ws = F.greatest(F.lit(0), F.least(F.lit(day_cap), (F.floor(F.get("q", F.lit(0)) / 30) * 30 - 30).cast("int")))
    dl = F.greatest(F.lit(0), F.least(F.lit(23 * 60 + 30), (F.ceil(F.get("q", F.lit(2)) / 30) * 30 + 60).cast("int")))
    found = F.col("cadence").isNotNull()
    return p.select(
        "institution",
        "days",
        "cadence",
        F.when(F.col("cadence") == "WEEKLY", F.col("wds")).alias("weekdays"),
        F.when((F.col("cadence") == "MONTHLY") & (F.size("peaks") > 0), F.col("peaks")).alias("month_days"),
        F.when(F.col("cadence") == "MONTHLY", F.col("use_last")).otherwise(False).alias("last_business_day"),
        F.when(found, ws).alias("window_start_min"),
        F.when(found, dl).alias("deadline_min"),
        F.when(found, F.bround(explained / F.col("days"), 3)).otherwise(0.0).alias("confidence"),
    )


def proposed_contracts(inferred: DataFrame, tz: str, version: int = 1) -> DataFrame:
    """Draft contract rows from inferred rules, watching record count, amount and customers."""

    def watch(metric: str, level: str) -> str:
        return f"named_struct('metric', '{metric}', 'sensitivity', '{level}', 'direction', 'BOTH')"

    c = F.col("cadence")
    key = F.when(c == "WEEKLY", "weekly").when(c == "MONTHLY", "monthly").otherwise("daily")
    label = F.when(c == "WEEKLY", "Haftalık borç dosyası").when(c == "MONTHLY", "Aylık borç dosyası").otherwise("Günlük borç dosyası")
    slot = F.struct(
        key.alias("key"),
        label.alias("label"),
        c.alias("cadence"),
        F.col("weekdays").cast("array<int>").alias("weekdays"),
        F.col("month_days").cast("array<int>").alias("month_days"),
        "last_business_day",
        F.lit("NEXT_BUSINESS_DAY").alias("holiday_shift"),
        "window_start_min",
        "deadline_min",
        F.lit(0).alias("grace_minutes"),
    )
    return inferred.filter("cadence is not null").select(
        "institution",
        F.lit(version).alias("version"),
        F.lit("DRAFT").alias("status"),
        F.lit(None).cast("date").alias("effective_from"),
        F.lit(tz).alias("timezone"),
        F.lit("TR").alias("calendar"),
        F.array(slot).alias("slots"),
        F.expr(f"array({watch('record_count', 'MEDIUM')}, {watch('total_amount', 'MEDIUM')}, {watch('customer_count', 'LOW')})").alias("metrics"),
        F.expr(f"cast(array() as array<{schemas.LIMIT}>)").alias("limits"),
        F.expr(schemas.DEFAULT_QUALITY_SQL).alias("quality"),
        F.expr(schemas.DEFAULT_LEARNING_SQL).alias("learning"),
    )


def rationale(inferred: DataFrame) -> Column:
    return F.concat(F.lit("Önerilen takvim geçmiş teslimatların "), pct(F.col("confidence")), F.lit("'ini açıklıyor."))
