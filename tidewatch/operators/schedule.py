"""Contracts x calendar -> expected deliveries."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch import fixed
from tidewatch.functions.scalar import local_to_utc
from tidewatch.operators.calendar import MAX_CALENDAR_ROWS
from tidewatch.session import broadcast_within, spread

PAD = timedelta(days=fixed.SHIFT_PAD_DAYS)
DAILY = ["BUSINESS_DAYS", "EVERY_DAY"]


def schedule_range(start: date, end: date) -> tuple[date, date]:
    """Days the calendar must cover so that dates shifted into [start, end] are found."""
    return start - PAD, end + PAD


def nominal_dates(contracts: DataFrame, cal: DataFrame, start: date, end: date) -> DataFrame:
    """One row per slot and nominal date, with the calendar's columns for that date; a day the calendar lacks is an error.

    Each slot's days are generated in place (``explode(sequence)``) and meet the calendar on
    (calendar, day); no cross join is involved.
    """
    lo, hi = schedule_range(start, end)
    slots = contracts.withColumn("slot", F.explode("slots")).withColumn("slot_key", F.col("slot.key"))
    days = slots.withColumn("day", F.explode(F.sequence(F.lit(lo), F.lit(hi))))
    dim = broadcast_within(cal, MAX_CALENDAR_ROWS)
    s = F.col("slot")
    in_month_days = F.exists(
        F.coalesce(s["month_days"], F.array().cast("array<int>")),
        lambda d: F.least(d, F.dayofmonth(F.last_day("day"))) == F.dayofmonth("day"),
    )
    on_last = F.coalesce(s["last_business_day"], F.lit(False)) & F.col("is_last_bd_of_month")
    keep = (
        F.when(s["cadence"] == "EVERY_DAY", F.lit(True))
        .when(s["cadence"] == "BUSINESS_DAYS", F.col("is_business_day"))
        .when(s["cadence"] == "WEEKLY", F.array_contains(s["weekdays"], F.col("iso_weekday")))
        .otherwise(in_month_days | on_last)
    )
    gap = F.concat(F.lit("the calendar does not cover "), F.coalesce("calendar", F.lit("null")), F.lit(" on "), F.col("day").cast("string"))
    keep = F.when(F.col("is_business_day").isNull(), F.raise_error(gap).cast("boolean")).otherwise(keep)
    return (
        days.join(dim, ["calendar", "day"], "left")
        .filter(keep)
        # Order in which collapsing nominals win: by month, month days before the last business day.
        .withColumn("gen_order", F.struct(F.trunc("day", "month").alias("m"), (~in_month_days).cast("int").alias("l"), F.col("day").alias("d")))
        .withColumnRenamed("day", "nominal_date")
    )


def shift_holidays(nominal: DataFrame) -> DataFrame:
    """Adds business_date; SKIP rows on non-business days are dropped."""
    s = F.col("slot")
    stays = s["cadence"].isin(DAILY) | F.col("is_business_day") | (s["holiday_shift"] == "NONE")
    bd = (
        F.when(stays, F.col("nominal_date"))
        .when(s["holiday_shift"] == "NEXT_BUSINESS_DAY", F.col("next_bd"))
        .when(s["holiday_shift"] == "PREVIOUS_BUSINESS_DAY", F.col("prev_bd"))
    )
    return nominal.withColumn("business_date", bd).filter(F.col("business_date").isNotNull())


def expand_schedule(contracts: DataFrame, cal: DataFrame, start: date, end: date, spill_days: tuple[int, int] = (0, 0)) -> DataFrame:
    """Expected deliveries with business_date in [start, end].

    ``contracts`` may carry valid_from / valid_to (see ``contract_validity``); a version then yields
    only dates inside its validity, widened by ``spill_days`` (days before, days after) for matching.

    Contracts are few bytes that grow into many days, so they are dealt to all tasks by institution first; the
    days of a slot then stay together, and collapsing them needs no further shuffle.
    """
    shifted = shift_holidays(nominal_dates(spread(contracts, "institution"), cal, start, end)).filter(
        F.col("business_date").between(F.lit(start), F.lit(end))
    )
    if "valid_from" in contracts.columns:
        before, after = spill_days
        shifted = shifted.filter(
            (F.col("business_date") >= F.date_sub("valid_from", before))
            & (F.col("valid_to").isNull() | (F.col("business_date") < F.date_add("valid_to", after)))
        )
    s = F.col("slot")
    keep = [c for c in ("version",) if c in contracts.columns]
    rows = shifted.select(
        "institution",
        *keep,
        "slot_key",
        "business_date",
        "nominal_date",
        local_to_utc(F.col("business_date"), s["window_start_min"], F.col("timezone")).alias("window_start_utc"),
        (
            local_to_utc(F.col("business_date"), s["deadline_min"], F.col("timezone"))
            + F.make_dt_interval(mins=F.coalesce(s["grace_minutes"], F.lit(0)))
        ).alias("deadline_utc"),
        "timezone",
        s["cadence"].alias("cadence"),
        s["label"].alias("slot_label"),
        "month_phase",
        "iso_weekday",
        "gen_order",
    )
    # Only shifted cadences can put two nominal dates on one business date; daily ones need no shuffle.
    key = ["institution", *keep, "slot_key", "business_date"]
    rest = [c for c in rows.columns if c not in (*key, "gen_order")]
    daily = rows.filter(F.col("cadence").isin(DAILY)).drop("gen_order")
    shifting = (
        rows.filter(~F.col("cadence").isin(DAILY))
        .groupBy(*key)
        .agg(F.min_by(F.struct(*rest), "gen_order").alias("r"))
        .select(*key, "r.*")
    )
    # The phase and weekday belong to the business date, not to the nominal one.
    out = daily.unionByName(shifting.select(*daily.columns)).drop("month_phase", "iso_weekday")
    codes = contracts.select("institution", *keep, "calendar").distinct()
    dim = broadcast_within(
        cal.select("calendar", F.col("day").alias("business_date"), "month_phase", "iso_weekday"), MAX_CALENDAR_ROWS
    )
    out = out.join(codes, ["institution", *keep]).join(dim, ["calendar", "business_date"], "left")
    gap = F.concat(F.lit("the calendar does not cover "), F.coalesce("calendar", F.lit("null")), F.lit(" on "), F.col("business_date").cast("string"))
    return out.withColumn("month_phase", F.when(F.col("iso_weekday").isNull(), F.raise_error(gap).cast("string")).otherwise(F.col("month_phase")))
