"""Was the delivery made, and when?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import fixed
from tidewatch.functions.scalar import hhmm, local_date, local_minutes
from tidewatch.operators.detectors import finding, none


def timeliness_case(now: Column) -> Column:
    """Which rule applies: the first that holds, or null."""
    first, dl, ws = F.col("first_received_at"), F.col("deadline_utc"), F.col("window_start_utc")
    tz, bd = F.col("timezone"), F.col("business_date")
    today = local_date(first, tz)
    waited = local_minutes(now, tz) > F.col("arrival.p97") + fixed.AT_RISK_MARGIN_MIN
    at_risk = F.col("arrival").isNotNull() & (local_date(now, tz) == bd) & (now >= ws) & waited
    drift = F.col("arrival").isNotNull() & (local_minutes(first, tz) > F.col("arrival.p97") + fixed.DRIFT_MARGIN_MIN)
    absent = F.col("load_count") == 0
    return (
        F.when(~F.col("expected"), F.when(~absent & (F.col("quality.unexpected_delivery") != "IGNORE"), "UNEXPECTED_DELIVERY"))
        .when(absent & (now >= dl), "MISSING_DELIVERY")
        .when(absent, F.when(at_risk, "DELIVERY_AT_RISK"))
        .when(first > dl, "LATE_DELIVERY")
        .when((first < ws) & (today == bd), "EARLY_DELIVERY")
        .when(today < bd, "EARLIER_DAY")
        .when(drift, "ARRIVAL_DRIFT")
    )


def status(case: Column) -> Column:
    return (
        F.when(~F.col("expected"), "UNSCHEDULED")
        .when(case == "MISSING_DELIVERY", "MISSING")
        .when(case == "DELIVERY_AT_RISK", "AT_RISK")
        .when(F.col("load_count") == 0, "PENDING")
        .when(case == "LATE_DELIVERY", "LATE")
        .otherwise("RECEIVED")
    )


def timeliness_finding(case: Column, now: Column) -> Column:
    """The one finding a case yields; evidence holds only what the case has."""
    first, dl, tz = F.col("first_received_at"), F.col("deadline_utc"), F.col("timezone")
    late = F.when(case == "LATE_DELIVERY", (F.unix_micros(first) - F.unix_micros(dl)) / 60e6)
    drift, risk = case == "ARRIVAL_DRIFT", case == "DELIVERY_AT_RISK"
    severity = (
        F.when(case == "UNEXPECTED_DELIVERY", F.col("quality.unexpected_delivery"))
        .when(case == "MISSING_DELIVERY", "CRITICAL")
        .when(risk, "WARNING")
        .when(late.isNotNull(), F.when(local_date(first, tz) > F.col("business_date"), "CRITICAL").otherwise("WARNING"))
        .otherwise("INFO")
    )
    evidence = F.struct(
        F.when(case == "UNEXPECTED_DELIVERY", first).alias("received_at"),
        hhmm(local_minutes(F.col("window_start_utc"), tz)).alias("window_start"),
        hhmm(local_minutes(dl, tz)).alias("deadline"),
        F.col("arrival").alias("arrival_profile"),
        F.when(risk, hhmm(local_minutes(now, tz))).alias("now"),
        hhmm(local_minutes(first, tz)).alias("arrived"),
        late.alias("late_minutes"),
    )
    return finding(
        code=F.when(case == "EARLIER_DAY", "EARLY_DELIVERY").otherwise(case),
        category="TIMELINESS",
        severity=severity,
        observed=F.coalesce(late, F.when(drift, local_minutes(first, tz).cast("double"))),
        expected=F.when(drift, F.col("arrival.median")),
        upper=F.when(drift, F.col("arrival.p97")),
        score=F.when(risk, local_minutes(now, tz) - F.col("arrival.median")),
        evidence=F.to_json(evidence),
    )


def detect_timeliness(occ: DataFrame, now: Column) -> DataFrame:
    """Adds status and timeliness_findings."""
    case = F.col("_case")
    found = F.when(case.isNotNull(), F.array(timeliness_finding(case, now))).otherwise(none())
    return (
        occ.withColumn("_case", timeliness_case(now)).withColumns({"status": status(case), "timeliness_findings": found}).drop("_case")
    )
