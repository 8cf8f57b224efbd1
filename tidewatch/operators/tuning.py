"""Contract changes proposed from analyst verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import fixed

# Fixed values of the rules.
MIN_FALSE_ALARMS, FALSE_ALARM_SHARE = 3, 0.6
LAST_MINUTE = 23 * 60 + 30


def resolved_findings(incidents: DataFrame, findings: DataFrame, since: Column) -> DataFrame:
    """One row per alerting finding of an occurrence per resolved incident of it."""
    key = ["institution", "slot_key", "business_date"]
    inc = incidents.filter(
        (F.col("status") == "RESOLVED") & (F.col("resolved_at") >= since) & F.col("resolution").isin("TRUE_POSITIVE", *fixed.NOISY_VERDICTS)
    ).select(*key, "resolution")
    arrived = F.get_json_object("evidence", "$.arrived")
    f = findings.filter(F.col("severity").isin(fixed.ALERT_SEVERITIES)).select(
        *key,
        "code",
        "metric",
        "observed",
        (F.substring(arrived, 1, 2).cast("int") * 60 + F.substring(arrived, 4, 2).cast("int")).alias("arrived_min"),
    )
    return inc.join(f, key)


def tuning_groups(resolved: DataFrame) -> DataFrame:
    """Verdict counts per (institution, family, metric or slot), with what the proposals need.

    Arrival minutes are at most 1 440 distinct values, so the exact percentile's map stays small.
    """
    volume = F.col("code").isin("VOLUME_LOW", "VOLUME_HIGH")
    noisy = F.col("resolution").isin(fixed.NOISY_VERDICTS)
    late = noisy & F.col("arrived_min").isNotNull()
    return (
        resolved.withColumns(
            {
                "family": F.when(volume, "VOLUME").otherwise(F.col("code")),
                "sub": F.when(volume, F.col("metric")).otherwise(F.col("slot_key")),
            }
        )
        .groupBy("institution", "family", "sub")
        .agg(
            F.count_if(noisy).alias("false_alarms"),
            F.count_if(F.col("resolution") == "TRUE_POSITIVE").alias("confirmed"),
            F.bool_and(F.when(noisy, F.col("code") == "VOLUME_HIGH")).alias("only_high"),
            F.bool_and(F.when(noisy, F.col("code") == "VOLUME_LOW")).alias("only_low"),
            # The smallest arrival that covers 90% of the false alarms.
            F.expr("percentile_disc(0.9) within group (order by arrived_min) filter (where resolution in ('FALSE_POSITIVE', 'NEW_NORMAL'))").alias("p90"),
            F.max(F.when(noisy, F.coalesce("observed", F.lit(0.0)))).alias("peak"),
        )
        .filter((F.col("false_alarms") >= MIN_FALSE_ALARMS) & (F.col("false_alarms") / (F.col("false_alarms") + F.col("confirmed")) >= FALSE_ALARM_SHARE))
    )


def suggest_tuning(contracts: DataFrame, resolved: DataFrame) -> DataFrame:
    """(institution, family, key, field, old_value, new_value, false_alarms, confirmed) for the contracts in force."""
    c = contracts.select("institution", "slots", F.col("metrics").alias("watches"), "quality")
    g = tuning_groups(resolved).join(c, "institution")
    watch = F.get(F.filter("watches", lambda w: w["metric"] == F.col("sub")), F.lit(0))
    slot = F.get(F.filter("slots", lambda s: s["key"] == F.col("sub")), F.lit(0))
    is_volume = (F.col("family") == "VOLUME") & F.col("sub").isNotNull()
    is_deadline = F.col("family").isin("LATE_DELIVERY", "DELIVERY_AT_RISK")
    lower = F.when(watch["sensitivity"] == "HIGH", "MEDIUM").when(watch["sensitivity"] == "MEDIUM", "LOW")
    one_way = F.when(F.col("only_high"), "LOW_ONLY").when(F.col("only_low"), "HIGH_ONLY")
    cur = slot["deadline_min"]
    target = F.coalesce(F.col("p90"), cur + 60)
    raised = F.least((F.ceil((target + 15) / 30) * 30).cast("int"), F.lit(LAST_MINUTE))
    deadline = F.when(raised <= cur, F.least(cur + 30, F.lit(LAST_MINUTE))).otherwise(raised)
    ratio = F.bround(F.least(F.lit(1.0), F.col("peak") * 1.25), 3)
    text = lambda x: x.cast("string")
    s = (
        F.when(is_volume & lower.isNotNull(), _change(F.concat(F.lit("volume:"), "sub"), "sensitivity", watch["sensitivity"], lower))
        .when(is_volume & watch.isNotNull() & one_way.isNotNull(), _change(F.concat(F.lit("volume:"), "sub"), "direction", watch["direction"], one_way))
        .when(is_deadline & slot.isNotNull(), _change(F.concat(F.lit("deadline:"), "sub"), "deadline_min", text(cur), text(deadline)))
        .when(
            (F.col("family") == "UNEXPECTED_DELIVERY") & (F.col("quality.unexpected_delivery") != "IGNORE"),
            _change(F.lit("unexpected:ignore"), "unexpected_delivery", F.col("quality.unexpected_delivery"), F.lit("IGNORE")),
        )
        .when(
            F.col("family") == "ZERO_AMOUNT_RECORDS",
            _change(F.lit("quality:zero_ratio"), "max_zero_amount_ratio", text(F.col("quality.max_zero_amount_ratio")), text(ratio)),
        )
    )
    return (
        g.withColumn("s", s)
        .filter("s is not null")
        .select("institution", "family", "s.*", "false_alarms", "confirmed")
    )


def _change(key: Column, field: str, old: Column, new: Column) -> Column:
    return F.struct(key.alias("key"), F.lit(field).alias("field"), old.alias("old_value"), new.alias("new_value"))


def propose(contracts: DataFrame, suggestions: DataFrame) -> DataFrame:
    """One candidate contract per suggestion: the contract in force with that one change."""
    j = contracts.join(suggestions, "institution")
    sub = F.element_at(F.split("key", ":"), 2)
    f, new = F.col("field"), F.col("new_value")
    metrics = F.transform(
        "metrics",
        lambda w: F.when(
            f.isin("sensitivity", "direction") & (w["metric"] == sub),
            F.struct(
                w["metric"].alias("metric"),
                F.when(f == "sensitivity", new).otherwise(w["sensitivity"]).alias("sensitivity"),
                F.when(f == "direction", new).otherwise(w["direction"]).alias("direction"),
            ),
        ).otherwise(w),
    )
    slots = F.transform(
        "slots", lambda s: F.when((f == "deadline_min") & (s["key"] == sub), s.withField("deadline_min", new.cast("int"))).otherwise(s)
    )
    q = F.col("quality")
    quality = (
        F.when(f == "unexpected_delivery", q.withField("unexpected_delivery", new))
        .when(f == "max_zero_amount_ratio", q.withField("max_zero_amount_ratio", new.cast("double")))
        .otherwise(q)
    )
    return j.select("institution", "key", "version", "timezone", "calendar", slots.alias("slots"), metrics.alias("metrics"), "limits", quality.alias("quality"), "learning")
