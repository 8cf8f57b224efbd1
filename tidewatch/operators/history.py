"""What was normal before each occurrence: previous delivery, arrival profile, reference levels, unit reference.

An occurrence is unique per (institution, slot, date), so every window partition here holds at most one
row per calendar day of one slot, whatever the number of files or records behind it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewatch import fixed
from tidewatch.functions.scalar import local_minutes, median_of, quantile_of, unit_scale_factor
from tidewatch.session import spread

SLOT = ["institution", "slot_key"]
KEY = [*SLOT, "business_date"]


def is_point() -> Column:
    """Occurrences later ones may learn from: expected ones that delivered."""
    return F.col("expected") & F.col("metrics").isNotNull() & (F.col("slot_key") != fixed.UNSCHEDULED_SLOT)


def history_days() -> Column:
    return F.greatest(F.col("learning.lookback_days"), F.lit(fixed.HISTORY_DAYS))


def frame(days: int = fixed.HISTORY_DAYS):  # noqa: ANN201
    return W.partitionBy(*SLOT).orderBy(F.unix_date("business_date")).rangeBetween(-days, -1)


def with_history(occ: DataFrame, value: Column, out: str = "history", days: int = fixed.HISTORY_DAYS) -> DataFrame:
    """Array of ``value`` over the preceding days, oldest first; rows where it is null are left out.

    ``days`` is the deepest history of any contract; where that exceeds the common depth, each row keeps
    the part its own contract asks for.
    """
    if days <= fixed.HISTORY_DAYS:
        return occ.withColumn(out, F.collect_list(value).over(frame(days)))
    day = F.unix_date("business_date")
    dated = F.when(value.isNotNull(), F.struct(day.alias("d"), value.alias("v")))
    own = F.filter(out, lambda p: p["d"] >= day - history_days())
    return occ.withColumn(out, F.collect_list(dated).over(frame(days))).withColumn(out, F.transform(own, lambda p: p["v"]))


def with_previous_delivery(occ: DataFrame) -> DataFrame:
    """Adds prev(business_date, metrics): the last earlier point inside the history, excluded ones included."""
    before = W.partitionBy(*SLOT).orderBy("business_date").rowsBetween(W.unboundedPreceding, -1)
    prev = F.last(F.when(is_point(), F.struct("business_date", "metrics")), ignorenulls=True).over(before)
    known = F.col("slot_key") != fixed.UNSCHEDULED_SLOT
    recent = F.datediff(F.col("business_date"), F.col("prev.business_date")) <= history_days()
    return occ.withColumn("prev", prev).withColumn("prev", F.when(known & recent, F.col("prev")))


def same_totals() -> Column:
    """Null equals null here, as for a metric absent from both deliveries."""
    same = F.lit(True)
    for m in fixed.REFERENCE_METRICS:
        same = same & F.col(f"metrics.{m}").eqNullSafe(F.col(f"prev.metrics.{m}"))
    return F.col("metrics").isNotNull() & F.col("prev").isNotNull() & same


UNIT_SCHEMA = "institution STRING, slot_key STRING, business_date DATE, unit_reference DOUBLE, unit_n INT"


def _unit_fold(pdf: pd.DataFrame) -> pd.DataFrame:
    """Median average amount of the last 30 points, skipping excluded ones.

    A suspect found here is excluded for the days after it, so one slot's days are walked in order; the
    group has one short row per day.
    """
    pdf = pdf.sort_values("business_date").reset_index(drop=True)
    day = pdf["day"].to_numpy()
    avg = pdf["avg"].to_numpy(dtype=float)
    point, pre, checked = (pdf[c].to_numpy(dtype=bool) for c in ("point", "pre", "checked"))
    depth = pdf["depth"].to_numpy()
    refs, counts = np.full(len(pdf), np.nan), np.zeros(len(pdf), dtype="int32")
    past_day, past_avg = [], []  # average is NaN where the point must not be learned from
    for i in range(len(pdf)):
        recent = [a for d, a in zip(past_day[-fixed.UNIT_WINDOW :], past_avg[-fixed.UNIT_WINDOW :]) if d >= day[i] - depth[i]]
        usable = [a for a in recent if a == a and a != 0]
        suspect = False
        if checked[i] and len(usable) >= fixed.UNIT_MIN_POINTS:
            refs[i], counts[i] = np.median(usable), len(usable)
            ratio = avg[i] / refs[i] if refs[i] else 0.0
            suspect = ratio > 0 and any(abs(ratio / f - 1) <= fixed.UNIT_TOLERANCE for f in fixed.UNIT_FACTORS)
        if point[i]:
            past_day.append(day[i])
            past_avg.append(np.nan if pre[i] or suspect else avg[i])
    return pd.DataFrame(
        {
            "institution": pdf["institution"],
            "slot_key": pdf["slot_key"],
            "business_date": pdf["business_date"],
            "unit_reference": refs,
            "unit_n": counts,
        }
    )


def unit_references(occ: DataFrame) -> DataFrame:
    """(KEY, unit_reference, unit_n). ``occ`` carries pre_excluded (label, repeated file or stale data)."""
    has = F.col("metrics.record_count") > 0
    narrow = occ.filter(F.col("metrics").isNotNull() & (F.col("slot_key") != fixed.UNSCHEDULED_SLOT)).select(
        *KEY,
        F.unix_date("business_date").alias("day"),
        F.coalesce("metrics.avg_amount", F.lit(0.0)).alias("avg"),
        is_point().alias("point"),
        F.col("pre_excluded").alias("pre"),
        (F.col("quality.detect_unit_scale") & has).alias("checked"),
        history_days().alias("depth"),
    )
    out = spread(narrow, *SLOT).groupBy(*SLOT).applyInPandas(_unit_fold, UNIT_SCHEMA)
    return out.withColumn("unit_reference", F.when(F.col("unit_n") > 0, F.col("unit_reference")))


def with_unit_scale(occ: DataFrame) -> DataFrame:
    ratio = F.try_divide(F.col("metrics.avg_amount"), F.col("unit_reference"))
    return (
        occ.join(unit_references(occ), KEY, "left")
        .withColumn("unit_ratio", ratio)
        .withColumn("unit_factor", unit_scale_factor(F.col("unit_ratio")))
    )


def mark_excluded(occ: DataFrame) -> DataFrame:
    """stale, pre_excluded, unit columns, excluded and regime_break, from labels and the content checks.

    ``occ`` may carry ``label`` (EXCLUDE or REGIME), prev and dup_load_id.
    """
    label = F.col("label") if "label" in occ.columns else F.lit(None).cast("string")
    dup = F.col("dup_load_id").isNotNull() & F.col("quality.detect_duplicate_file")
    out = occ.withColumns({"duplicate": dup, "stale": ~dup & F.col("quality.detect_stale_data") & same_totals()})
    out = out.withColumn("pre_excluded", F.coalesce(label == "EXCLUDE", F.lit(False)) | F.col("duplicate") | F.col("stale"))
    out = with_unit_scale(out)
    return out.withColumns(
        {
            "excluded": F.col("pre_excluded") | F.col("unit_factor").isNotNull(),
            "regime_break": F.coalesce(label == "REGIME", F.lit(False)),
        }
    )


def with_arrival_profile(occ: DataFrame, last: int = fixed.ARRIVAL_POINTS, days: int = fixed.HISTORY_DAYS) -> DataFrame:
    """arrival(median, p90, p97, n) of the last clean first arrivals; null while learning."""
    usable = is_point() & ~F.col("excluded") & F.col("first_received_at").isNotNull()
    minutes = F.when(usable, local_minutes(F.col("first_received_at"), F.col("timezone")))
    arr = F.col("_arr")
    cut = F.slice(arr, -F.least(F.size(arr), F.lit(last)), last)
    profile = F.struct(
        quantile_of(F.col("_cut"), 0.5).alias("median"),
        quantile_of(F.col("_cut"), 0.9).alias("p90"),
        quantile_of(F.col("_cut"), 0.97).alias("p97"),
        F.size("_cut").alias("n"),
    )
    enough = (F.col("slot_key") != fixed.UNSCHEDULED_SLOT) & (F.size("_arr") >= F.col("learning.min_history"))
    return (
        with_history(occ, minutes, "_arr", days)
        .withColumn("_cut", F.sort_array(F.when(F.size(arr) > 0, cut).otherwise(F.array().cast("array<int>"))))
        .withColumn("arrival", F.when(enough, profile))
        .drop("_arr", "_cut")
    )


def with_reference(occ: DataFrame, n: int = fixed.REFERENCE_POINTS, days: int = fixed.HISTORY_DAYS) -> DataFrame:
    """reference(record_count, total_amount, customer_count): medians of the last clean deliveries."""
    m = F.struct(*[F.col(f"metrics.{x}").alias(x) for x in fixed.REFERENCE_METRICS])
    pts = F.col("_pts")
    cut = F.when(F.size(pts) > 0, F.slice(pts, -F.least(F.size(pts), F.lit(n)), n))
    ordered = {f"_s_{x}": F.sort_array(F.col(f"_cut.{x}")) for x in fixed.REFERENCE_METRICS}
    ref = F.struct(*[median_of(F.col(f"_s_{x}")).alias(x) for x in fixed.REFERENCE_METRICS])
    known = F.col("slot_key") != fixed.UNSCHEDULED_SLOT
    return (
        with_history(occ, F.when(is_point() & ~F.col("excluded"), m), "_pts", days)
        .withColumn("_cut", cut)
        .withColumns(ordered)
        .withColumn("reference", F.when(known & F.col("_cut").isNotNull(), ref))
        .drop("_pts", "_cut", *ordered)
    )
