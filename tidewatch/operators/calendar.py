"""Business calendar as one small dimension; its helpers are columns of it."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewatch.functions.scalar import iso_weekday

MAX_CALENDAR_ROWS = 500_000  # days x calendar codes that still travel to every executor
NEIGHBOUR_DAYS = 40  # longest search for a neighbouring business day, and a whole month


def calendar_dim(spark: SparkSession, holidays: DataFrame, start: date, end: date, contracts: DataFrame | None = None) -> DataFrame:
    """One row per calendar code and day in [start, end]; codes come from the holidays and, if given, the contracts.

    A code without holidays has its weekends only.

    Columns: calendar, day, iso_weekday, is_business_day, is_half_day, bd_ordinal, month_phase,
    next_bd, prev_bd, last_bd_of_month, is_last_bd_of_month. The dimension holds (days x codes) rows,
    whatever the size of the data.
    """
    # Margins around the range, so that neighbours and month phases at its ends are right.
    lo = start - timedelta(days=NEIGHBOUR_DAYS)
    hi = end + timedelta(days=NEIGHBOUR_DAYS)
    codes = holidays.select("calendar")
    if contracts is not None:
        codes = codes.union(contracts.select("calendar").where("calendar is not null"))
    codes = codes.distinct()
    days = codes.select("calendar", F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("day"))
    h = holidays.groupBy("calendar", "day").agg(
        F.bool_and("is_half_day").alias("_half")
    )
    wd = iso_weekday(F.col("day"))
    base = days.join(h, ["calendar", "day"], "left").select(
        "calendar",
        "day",
        wd.alias("iso_weekday"),
        (~wd.isin(6, 7) & F.coalesce("_half", F.lit(True))).alias("is_business_day"),
        F.coalesce("_half", F.lit(False)).alias("is_half_day"),
    )
    by_cal = W.partitionBy("calendar").orderBy("day")
    month = F.trunc("day", "month")
    by_month = W.partitionBy("calendar", month).orderBy("day")
    bd = F.when(F.col("is_business_day"), F.col("day"))
    one = F.col("is_business_day").cast("int")
    unb = W.unboundedPreceding
    seen = F.sum(one).over(by_month.rowsBetween(unb, 0))
    left = F.sum(one).over(by_month.rowsBetween(0, W.unboundedFollowing))
    last_bd = F.max(bd).over(W.partitionBy("calendar", month))
    out = base.select(
        "*",
        F.sum(one).over(by_cal.rowsBetween(unb, 0)).alias("bd_ordinal"),
        F.when(seen <= 3, "START").when(left <= 3, "END").otherwise("MID").alias("month_phase"),
        F.first(bd, ignorenulls=True).over(by_cal.rowsBetween(1, W.unboundedFollowing)).alias("next_bd"),
        F.last(bd, ignorenulls=True).over(by_cal.rowsBetween(unb, -1)).alias("prev_bd"),
        last_bd.alias("last_bd_of_month"),
    )
    return out.withColumn("is_last_bd_of_month", F.col("day") == F.col("last_bd_of_month")).filter(
        F.col("day").between(F.lit(start), F.lit(end))
    )


def with_business_days_between(df: DataFrame, cal: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Business days in (a, b], negative when b lies before a: a difference of running ordinals."""
    ends = cal.select("calendar", "day", "bd_ordinal")
    return (
        df.join(ends.withColumnsRenamed({"day": a, "bd_ordinal": "_oa"}), ["calendar", a], "left")
        .join(ends.withColumnsRenamed({"day": b, "bd_ordinal": "_ob"}), ["calendar", b], "left")
        .withColumn(out, F.col("_ob") - F.col("_oa"))
        .drop("_oa", "_ob")
    )


def with_neighbours(df: DataFrame, cal: DataFrame, day: str, inclusive: bool) -> DataFrame:
    """Adds next_business_day and previous_business_day of a date column."""
    pick = cal.select("calendar", F.col("day").alias(day), "is_business_day", "next_bd", "prev_bd")

    def chosen(c: str) -> Column:
        return F.when(F.lit(inclusive) & F.col("is_business_day"), F.col(day)).otherwise(F.col(c))

    return (
        df.join(pick, ["calendar", day], "left")
        .withColumns({"next_business_day": chosen("next_bd"), "previous_business_day": chosen("prev_bd")})
        .drop("is_business_day", "next_bd", "prev_bd")
    )


def get_calendar(holidays: DataFrame, code: str) -> DataFrame:
    return holidays.filter(F.col("calendar") == code)
