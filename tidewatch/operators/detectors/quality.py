"""Content checks: repeated file, unchanged data, unit errors, zero, negative and repeated records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.detectors import finding, some


def duplicate_file() -> Column:
    return F.when(
        F.col("duplicate"),
        finding(
            code="DUPLICATE_FILE",
            category="QUALITY",
            severity="CRITICAL",
            evidence=F.to_json(F.struct(F.col("dup_load_id").alias("load_id"), F.col("dup_hash").alias("content_hash"))),
        ),
    )


def stale_data() -> Column:
    prev = F.col("prev.business_date")
    return F.when(
        F.col("stale"),
        finding(
            code="STALE_DATA",
            category="QUALITY",
            severity="WARNING",
            evidence=F.to_json(F.struct(prev.alias("previous_date"))),
        ),
    )


def unit_scale() -> Column:
    f, avg, ref = F.col("unit_factor"), F.col("metrics.avg_amount"), F.col("unit_reference")
    return F.when(
        f.isNotNull(),
        finding(
            code="UNIT_SCALE_SUSPECT",
            category="QUALITY",
            severity="CRITICAL",
            metric="avg_amount",
            observed=avg,
            expected=ref,
            score=F.col("unit_ratio"),
            evidence=F.to_json(F.struct(F.col("unit_ratio").alias("ratio"), f.alias("factor"), F.col("unit_n").alias("reference_n"))),
        ),
    )


def zero_amounts() -> Column:
    v, top = F.col("metrics.zero_amount_ratio"), F.col("quality.max_zero_amount_ratio")
    return F.when(
        v > top,
        finding(
            code="ZERO_AMOUNT_RECORDS",
            category="QUALITY",
            severity=F.when(v > 3 * top, "CRITICAL").otherwise("WARNING"),
            metric="zero_amount_ratio",
            observed=v,
            upper=top,
        ),
    )


def negative_amounts() -> Column:
    v = F.col("metrics.negative_amount_count")
    return F.when(
        F.col("quality.forbid_negative_amounts") & (v > 0),
        finding(
            code="NEGATIVE_AMOUNTS",
            category="QUALITY",
            severity="CRITICAL",
            metric="negative_amount_count",
            observed=v,
            upper=F.lit(0.0),
        ),
    )


def duplicate_records() -> Column:
    v, top = F.col("metrics.duplicate_record_ratio"), F.col("quality.max_duplicate_record_ratio")
    return F.when(
        v > top,
        finding(
            code="DUPLICATE_RECORDS",
            category="QUALITY",
            severity="WARNING",
            metric="duplicate_record_ratio",
            observed=v,
            upper=top,
        ),
    )


CHECKS = {
    "DUPLICATE_FILE": duplicate_file,
    "STALE_DATA": stale_data,
    "UNIT_SCALE_SUSPECT": unit_scale,
    "ZERO_AMOUNT_RECORDS": zero_amounts,
    "NEGATIVE_AMOUNTS": negative_amounts,
    "DUPLICATE_RECORDS": duplicate_records,
}


def detect_quality(occ: DataFrame) -> DataFrame:
    """Adds quality_findings. ``occ`` carries the columns of ``mark_excluded``."""
    return occ.withColumn("quality_findings", some(*[check() for check in CHECKS.values()]))
