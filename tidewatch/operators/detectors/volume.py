"""Deviations from the learned band, and composition shifts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import fixed
from tidewatch.operators.baseline import metric_map
from tidewatch.operators.detectors import finding

CRITICAL_LOW, CRITICAL_HIGH = 0.5, 2.0
VOLUME_METRICS = ["record_count", "total_amount", "customer_count", "avg_amount"]
AMOUNT_METRICS = ["total_amount", "avg_amount"]


def z_score(value: Column, b: Column) -> Column:
    return (F.log1p(F.greatest(value, F.lit(0.0))) - b["center_log"]) / b["scale_log"]


def skipped_metrics() -> Column:
    """Metrics explained by a content finding: unit errors explain amounts, repeated or stale data explains all."""
    codes = F.transform("quality_findings", lambda f: f["code"])
    no_metric = F.array().cast("array<string>")
    return F.concat(
        F.when(F.array_contains(codes, "UNIT_SCALE_SUSPECT"), F.array(*[F.lit(m) for m in AMOUNT_METRICS])).otherwise(no_metric),
        F.when(
            F.array_contains(codes, "DUPLICATE_FILE") | F.array_contains(codes, "STALE_DATA"),
            F.array(*[F.lit(m) for m in VOLUME_METRICS]),
        ).otherwise(no_metric),
    )


def volume_findings() -> Column:
    """Over watches; ``_values`` (metric map), baselines and ``_skip`` are columns of the row."""

    def check(w: Column) -> Column:
        m = w["metric"]
        b, v = F.element_at(F.col("baselines"), m), F.element_at(F.col("_values"), m)
        z = z_score(v, b)
        low = (z < -b["k"]) & (w["direction"] != "HIGH_ONLY")
        high = (z > b["k"]) & (w["direction"] != "LOW_ONLY")
        ratio = F.when(b["expected"] != 0, v / b["expected"]).otherwise(F.lit(float("inf")))
        critical = (low & (ratio < CRITICAL_LOW)) | (high & (ratio > CRITICAL_HIGH))
        return F.when(
            F.coalesce(low | high, F.lit(False)) & ~F.array_contains(F.col("_skip"), m),
            finding(
                code=F.when(low, "VOLUME_LOW").otherwise("VOLUME_HIGH"),
                category="VOLUME",
                severity=F.when(critical, "CRITICAL").otherwise("WARNING"),
                metric=m,
                observed=v,
                expected=b["expected"],
                lower=b["lower"],
                upper=b["upper"],
                score=z,
                evidence=F.to_json(F.struct(b.alias("baseline"), z.alias("z"), ratio.alias("ratio"), w["sensitivity"].alias("sensitivity"))),
            ),
        )

    return F.array_compact(F.transform(F.col("watches"), check))


def detect_volume(occ: DataFrame) -> DataFrame:
    """Adds volume_findings. ``occ`` carries baselines, watches, metrics and quality_findings."""
    return (
        occ.withColumns({"_values": metric_map(), "_skip": skipped_metrics()})
        .withColumn("volume_findings", volume_findings())
        .drop("_values", "_skip")
    )


def mix_findings(names: list[str]) -> Column:
    """MIX_SHIFT per ratio outside its MEDIUM band; ``ratio_baselines`` maps ratio -> baseline."""
    out = []
    for name in names:
        over, under, _ = fixed.RATIOS[name]
        v = F.try_divide(F.col(f"metrics.{over}"), F.col(f"metrics.{under}"))
        b = F.element_at(F.col("ratio_baselines"), name)
        z = z_score(v, b)
        out.append(
            F.when(
                F.col("expected") & (F.col("load_count") > 0) & (F.abs(z) > b["k"]),
                finding(
                    code="MIX_SHIFT",
                    category="VOLUME",
                    severity="WARNING",
                    metric=name,
                    observed=v,
                    expected=b["expected"],
                    lower=b["lower"],
                    upper=b["upper"],
                    score=z,
                    evidence=F.to_json(F.struct(b.alias("baseline"))),
                ),
            )
        )
    return F.array_compact(F.array(*out))
