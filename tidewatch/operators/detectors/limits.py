"""Hard limits of the contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.baseline import metric_map
from tidewatch.operators.detectors import finding


def limit_findings() -> Column:
    values = F.col("_values")

    def check(x: Column) -> Column:
        v = F.element_at(values, x["metric"])
        below = F.coalesce(v < x["min"], F.lit(False))
        above = F.coalesce(v > x["max"], F.lit(False))
        return F.when(
            below | above,
            finding(
                code="LIMIT_BREACH",
                category="RULE",
                severity=x["severity"],
                metric=x["metric"],
                observed=v,
                lower=x["min"],
                upper=x["max"],
                evidence=F.to_json(F.struct(x["id"].alias("limit_id"), x["note"].alias("note"))),
            ),
        )

    return F.array_compact(F.transform(F.col("limits"), check))


def detect_limits(occ: DataFrame) -> DataFrame:
    """Adds limit_findings (empty where nothing was delivered)."""
    return occ.withColumn("_values", metric_map()).withColumn("limit_findings", limit_findings()).drop("_values")
