"""Judge occurrences: status, findings, baselines and severity. One code path for batch, replay and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import fixed
from tidewatch.functions.scalar import local_minutes, severity_name, severity_rank
from tidewatch.operators.baseline import ratio_values, watched_values, with_baselines
from tidewatch.operators.contracts import contract_validity
from tidewatch.operators.detectors import none
from tidewatch.operators.detectors.limits import detect_limits
from tidewatch.operators.detectors.quality import detect_quality
from tidewatch.operators.detectors.timeliness import detect_timeliness
from tidewatch.operators.detectors.volume import detect_volume, mix_findings
from tidewatch.operators.history import mark_excluded, with_arrival_profile, with_previous_delivery, with_reference
from tidewatch.session import settle

KEY = ["institution", "slot_key", "business_date"]


def attach_spec(occ: DataFrame, contracts: DataFrame) -> DataFrame:
    """Adds the rules in force on the business date: quality, learning, limits and watches.

    A delivery that no version covers (a file that a later version's window pulled before its first day) stays, without
    rules: no watches or limits, and null quality and learning.
    """
    c = contract_validity(contracts).select(
        "institution",
        F.col("version").alias("contract_version"),
        "valid_from",
        "valid_to",
        "quality",
        "learning",
        F.coalesce("limits", F.array()).alias("limits"),
        F.coalesce(F.col("metrics"), F.array()).alias("watches"),
    )
    on = F.col("o.business_date")
    cond = (
        (F.col("o.institution") == F.col("c.institution"))
        & (on >= F.col("c.valid_from"))
        & (F.col("c.valid_to").isNull() | (on < F.col("c.valid_to")))
    )
    rules = [F.coalesce(f"c.{x}", F.array().cast(c.schema[x].dataType)).alias(x) for x in ("limits", "watches")]
    return occ.alias("o").join(c.alias("c"), cond, "left").select("o.*", "c.contract_version", "c.quality", "c.learning", *rules)


def learn(occ: DataFrame, labels: DataFrame | None, depth: int = fixed.HISTORY_DAYS) -> DataFrame:
    """Everything an occurrence is compared with, from the occurrences before it."""
    if labels is not None:
        occ = occ.join(labels.select(*KEY, "label"), KEY, "left")
    marked = mark_excluded(with_previous_delivery(occ))
    return with_reference(with_arrival_profile(marked, days=depth), days=depth)


def judge(learned: DataFrame, now: Column) -> DataFrame:
    """Adds status, findings, max_severity and first_arrival_minutes.

    Order of findings: timeliness, content, volume, limits. Unscheduled files get content checks and
    limits only; a delivery that did not come gets timeliness only.
    """
    out = detect_limits(detect_volume(detect_quality(detect_timeliness(learned, now))))
    came = F.col("load_count") > 0
    found = F.concat(
        F.col("timeliness_findings"),
        F.when(came, F.col("quality_findings")).otherwise(none()),
        F.when(came & F.col("expected"), F.col("volume_findings")).otherwise(none()),
        F.when(came, F.col("limit_findings")).otherwise(none()),
    )
    return (
        out.withColumn("findings", found)
        .drop("timeliness_findings", "quality_findings", "volume_findings", "limit_findings")
        .withColumns({"judged_at": now, "max_severity": max_severity(F.col("findings")), "first_arrival_minutes": local_minutes(F.col("first_received_at"), F.col("timezone"))})
    )


def max_severity(findings: Column) -> Column:
    return severity_name(F.array_max(F.transform(findings, lambda f: severity_rank(f["severity"]))))


def evaluate(
    occ: DataFrame, contracts: DataFrame, now: Column, labels: DataFrame | None = None, engine: str = "champion", depth: int = fixed.HISTORY_DAYS
) -> DataFrame:
    """Decisions for every occurrence that is due: future windows without files are left out."""
    ready = F.col("window_start_utc").isNull() | (F.col("window_start_utc") <= now) | (F.col("load_count") > 0)
    learned = settle(learn(attach_spec(occ.filter(ready), contracts), labels, depth), "learned")
    return ENGINES[engine](learned, now)


def champion(learned: DataFrame, now: Column) -> DataFrame:
    return judge(with_baselines(learned, watched_values()), now)


def challenger(names: list[str]) -> Callable[[DataFrame, Column], DataFrame]:
    """The champion's decision plus composition findings on the given ratios."""

    def run(learned: DataFrame, now: Column) -> DataFrame:
        base = with_baselines(champion(learned, now), ratio_values(names), "ratio_baselines")
        found = F.concat("findings", mix_findings(names))
        return (
            base.withColumn("findings", found).drop("ratio_baselines").withColumn("max_severity", max_severity(F.col("findings")))
        )

    return run


ENGINES: dict[str, Callable[[DataFrame, Column], DataFrame]] = {
    "champion": champion,
    "mix-shift-v1": challenger(["records_per_customer", "amount_per_record"]),
    "mix-shift-v2": challenger(["records_per_customer"]),
}
CHALLENGERS = [e for e in ENGINES if e != "champion"]


def explode_findings(decisions: DataFrame, *extra: str) -> DataFrame:
    """One row per finding, with its position in the decision."""
    return decisions.select(*KEY, *extra, F.posexplode("findings").alias("ord", "f")).select(*KEY, *extra, "ord", "f.*").withColumn(
        "severity_rank", severity_rank(F.col("severity"))
    )


def actionable_findings(findings: DataFrame) -> DataFrame:
    return findings.filter(F.col("severity").isin(fixed.ALERT_SEVERITIES))
