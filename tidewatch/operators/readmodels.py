"""Tables for the operators' screens: boards, health, trends, detector quality."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import fixed
from tidewatch.functions.quantiles import grouped_median
from tidewatch.functions.scalar import local_date, local_minutes
from tidewatch.operators.contracts import effective_contract
from tidewatch.operators.evaluate import KEY

STATUS_ORDER = ["MISSING", "AT_RISK", "LATE", "PENDING", "UNSCHEDULED", "RECEIVED"]
UNRESOLVED = "status <> 'RESOLVED'"


def list_incidents(
    incidents: DataFrame,
    status: list[str] | None = None,
    priority: list[str] | None = None,
    category: list[str] | None = None,
    institution: str | None = None,
    q: str | None = None,
    limit: int = 50,
    offset: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """(page, total): unresolved first, then by priority, then newest."""
    out = incidents
    for name, values in (("status", status), ("priority", priority), ("category", category)):
        if values:
            out = out.filter(F.col(name).isin(values))
    if institution:
        out = out.filter(F.col("institution") == institution)
    if q:
        out = out.filter(F.col("title").ilike(f"%{q}%"))
    page = out.orderBy((F.col("status") == "RESOLVED").asc(), "priority", F.desc("opened_at"), "incident_id").offset(offset).limit(limit)
    return page, out.agg(F.count("*").alias("total"))


def list_audit(audit: DataFrame, entity_type: str | None = None, limit: int = 100) -> DataFrame:
    out = audit if entity_type is None else audit.filter(F.col("entity_type") == entity_type)
    return out.orderBy(F.desc("id")).limit(limit)


def open_occurrences(occ: DataFrame, now: Column) -> DataFrame:
    """Occurrences a sweep must look at again."""
    return occ.filter(F.col("status").isin("PENDING", "AT_RISK") & F.col("expected") & (F.col("window_start_utc") <= now))


def open_by_priority(incidents: DataFrame) -> DataFrame:
    return incidents.filter(UNRESOLVED).groupBy("priority").agg(F.count("*").alias("n"))


def deliveries_kpi(occ: DataFrame, now: datetime, days: int = 30) -> DataFrame:
    """One row: deliveries due in the period by outcome."""
    due = occ.filter(F.col("expected") & F.col("deadline_utc").between(F.lit(now - timedelta(days=days)), F.lit(now)))
    n = F.count("*")
    return due.agg(
        F.when(n > 0, F.bround(F.count_if(F.col("status") == "RECEIVED") / n, 4)).alias("on_time_rate"),
        F.count_if(F.col("status") == "LATE").alias("late"),
        F.count_if(F.col("status") == "MISSING").alias("missing"),
        n.alias("deliveries"),
    )


HOUR = 3_600_000_000.0


def median_minutes(rows: DataFrame, start: str, end: str, out: str) -> DataFrame:
    """Median minutes between two timestamps, to one decimal."""
    d = F.unix_micros(end) - F.unix_micros(start)
    return grouped_median(rows, [], d, HOUR, "d").select(F.bround(F.col("d") / 60e6, 1).alias(out))


def response_times(incidents: DataFrame, now: datetime, days: int = 30) -> DataFrame:
    """One row: median minutes to acknowledge and to resolve by an analyst."""
    recent = incidents.filter(F.col("opened_at") >= F.lit(now - timedelta(days=days)))
    ack = median_minutes(recent, "opened_at", "acknowledged_at", "median_minutes_to_acknowledge")
    done = median_minutes(recent.filter(F.col("resolution").isin(fixed.ANALYST_VERDICTS)), "opened_at", "resolved_at", "median_minutes_to_resolve")
    return incidents.sparkSession.range(1).select(
        ack.scalar().alias("median_minutes_to_acknowledge"), done.scalar().alias("median_minutes_to_resolve")
    )


def best_open_incident(incidents: DataFrame) -> DataFrame:
    """The most urgent unresolved incident per occurrence."""
    return (
        incidents.filter(UNRESOLVED)
        .filter("business_date is not null")
        .groupBy(*KEY)
        .agg(F.min(F.struct("priority", "incident_id")).alias("i"))
        .select(*KEY, F.col("i.incident_id").alias("incident_id"), F.col("i.priority").alias("incident_priority"))
    )


def today_board(occ: DataFrame, incidents: DataFrame, institutions: DataFrame, day: date, tz: str) -> DataFrame:
    """Today's occurrences with local minutes and the best open incident, by deadline then name."""
    zone = F.lit(tz)
    today = occ.filter(F.col("business_date") == F.lit(day))
    return (
        today.join(institutions.select("institution", "tier"), "institution")
        .join(best_open_incident(incidents.filter(F.col("business_date") == F.lit(day))), KEY, "left")
        .orderBy(F.col("deadline_utc").asc_nulls_last(), "institution")
        .select(
            "institution",
            "tier",
            "slot_key",
            "status",
            local_minutes(F.col("window_start_utc"), zone).alias("window_start"),
            local_minutes(F.col("deadline_utc"), zone).alias("deadline"),
            local_minutes(F.col("first_received_at"), zone).alias("first_received"),
            "max_severity",
            "incident_id",
            "incident_priority",
        )
    )


def status_rank(status: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in STATUS_ORDER]), status)


def status_rank_board(board: DataFrame) -> DataFrame:
    return board.orderBy(status_rank(F.col("status")), F.col("deadline").asc_nulls_last(), "institution")


def institutions_health(
    occ: DataFrame, incidents: DataFrame, institutions: DataFrame, contracts: DataFrame, loads: DataFrame, now: datetime, today: date
) -> DataFrame:
    """One row per institution: 30-day outcome, open incidents, last delivery, today's statuses, contract."""
    since = now - timedelta(days=30)
    due = F.col("expected") & F.col("deadline_utc").between(F.lit(since), F.lit(now))
    is_today = F.col("business_date") == F.lit(today)
    stats = (
        occ.filter(due | is_today)
        .groupBy("institution")
        .agg(
            F.count_if(due).alias("_n"),
            F.count_if(due & (F.col("status") == "RECEIVED")).alias("_ok"),
            F.count_if(due & (F.col("status") == "LATE")).alias("late_30d"),
            F.count_if(due & (F.col("status") == "MISSING")).alias("missing_30d"),
            F.array_sort(F.collect_list(F.when(is_today, F.struct("slot_key", "status")))).alias("_today"),
        )
    )
    opened = incidents.filter(UNRESOLVED).filter("institution is not null").groupBy("institution").agg(F.count("*").alias("open_incidents"))
    last = loads.groupBy("institution").agg(F.max("received_at").alias("last_delivery_at"))
    in_force = effective_contract(institutions.select("institution", F.lit(today).alias("on")), contracts)
    con = in_force.select("institution", F.col("version").alias("contract_version"), F.array_join(F.col("slots.label"), ", ").alias("cadence"))
    out = institutions
    for part in (stats, opened, last, con):
        out = out.join(part, "institution", "left")
    zero = F.lit(0).cast("bigint")
    return out.orderBy("tier", "institution").select(
        "institution",
        "sector",
        "tier",
        "active",
        "contract_version",
        "cadence",
        F.when(F.col("_n") > 0, F.bround(F.col("_ok") / F.col("_n"), 4)).alias("on_time_rate_30d"),
        F.coalesce("late_30d", zero).alias("late_30d"),
        F.coalesce("missing_30d", zero).alias("missing_30d"),
        F.coalesce("open_incidents", zero).alias("open_incidents"),
        "last_delivery_at",
        F.coalesce(F.col("_today.status"), F.array().cast("array<string>")).alias("today"),
    )


def institution_series(decisions: DataFrame, incidents: DataFrame, institution: str, metric: str, today: date, days: int) -> DataFrame:
    """Observed value and band per occurrence of one institution, for a chart."""
    rows = decisions.filter(
        (F.col("institution") == institution) & F.col("business_date").between(F.lit(today - timedelta(days=days)), F.lit(today))
    )
    inc = (
        incidents.filter(F.col("institution") == institution)
        .groupBy(*KEY)
        .agg(F.max(F.struct("incident_id", "status", "resolution")).alias("i"))
    )
    b = F.try_element_at("baselines", F.lit(metric))
    watched = F.exists("watches", lambda w: w["metric"] == metric)
    return (
        rows.join(inc, KEY, "left")
        .orderBy("business_date", "slot_key")
        .select(
            *KEY,
            F.col("status"),
            F.col("expected").alias("expected_slot"),
            F.col(f"metrics.{metric}").alias("observed"),
            b["expected"].alias("expected"),
            b["lower"].alias("lower"),
            b["upper"].alias("upper"),
            (watched & F.col("expected") & b.isNull()).alias("learning"),
            "max_severity",
            "excluded",
            "regime_break",
            F.col("i.incident_id").alias("incident_id"),
            F.col("i.status").alias("incident_status"),
            F.col("i.resolution").alias("resolution"),
        )
    )


def _outcome() -> Column:
    return F.coalesce("resolution", F.when(F.col("status") != "RESOLVED", "OPEN").otherwise("OTHER"))


def _by(rows: DataFrame, key: str) -> DataFrame:
    """Counts per outcome, and precision = confirmed / (confirmed + false alarms + new normals)."""
    wide = rows.groupBy(key).agg(
        F.count("*").alias("total"), *[F.count_if(F.col("_res") == r).alias(r.lower()) for r in fixed.INSIGHT_RESOLUTIONS]
    )
    labelled = F.col("true_positive") + F.col("false_positive") + F.col("new_normal")
    return wide.withColumn("precision", F.when(labelled > 0, F.bround(F.col("true_positive") / labelled, 3)))


def insights(incidents: DataFrame, now: datetime, days: int = 90, tz: str = fixed.DEFAULT_TIMEZONE) -> dict[str, DataFrame]:
    """by_code, by_institution, weekly and totals of the incidents opened in the period."""
    recent = incidents.filter(F.col("opened_at") >= F.lit(now - timedelta(days=days))).withColumn("_res", _outcome())
    named = recent.withColumn("institution", F.coalesce("institution", F.lit(fixed.SYSTEMIC_LABEL)))
    week = F.to_date(F.date_trunc("week", local_date(F.col("opened_at"), F.lit(tz))))
    return {
        "by_code": _by(recent.withColumn("code", F.explode("codes")), "code").orderBy(F.desc("total"), "code"),
        "by_institution": _by(named, "institution").orderBy(F.desc("total"), "institution"),
        "weekly": recent.groupBy(week.alias("week")).agg(F.count("*").alias("n")).orderBy("week"),
        "totals": recent.agg(
            F.count("*").alias("total_incidents"),
            F.count_if(F.col("resolution") == "AUTO_CLEARED").alias("auto_cleared"),
            F.count_if(F.col("resolution") == "SUPPRESSED").alias("suppressed"),
        ),
    }


def labels_and_verdicts(occ: DataFrame, incidents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels from stored flags (REGIME beats EXCLUDE) and one verdict row per analyst decision."""
    labels = occ.filter("excluded or regime_break").select(*KEY, F.when(F.col("regime_break"), "REGIME").otherwise("EXCLUDE").alias("label"))
    verdicts = incidents.filter(
        (F.col("status") == "RESOLVED") & F.col("resolution").isin(["TRUE_POSITIVE", "FALSE_POSITIVE", "EXPECTED_EVENT", "NEW_NORMAL"])
    ).join(occ.select(*KEY), KEY, "left_semi")
    return labels, verdicts.select(*KEY, "category", "resolution")


def pipeline_health(loads: DataFrame, assigned: DataFrame, occ: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
    """(unassigned loads and their oldest age in seconds, evaluations of the last day by status)."""
    waiting = loads.join(assigned.filter("slot_key is not null").select("load_id"), "load_id", "left_anti")
    oldest = F.unix_timestamp(F.lit(now)) - F.unix_timestamp(F.min("received_at"))
    backlog = waiting.agg(F.count("*").alias("unassigned"), F.coalesce(oldest, F.lit(0).cast("bigint")).alias("oldest_age_seconds"))
    day = occ.filter(F.col("evaluated_at") >= F.lit(now - timedelta(hours=24))).groupBy("status").agg(F.count("*").alias("n"))
    return backlog, day


# --- quality against known truths --------------------------------------------------------------------


def _kind_codes(kind: Column) -> Column:
    out = F.array().cast("array<string>")
    for k, codes in fixed.EXPECTED_CODES.items():
        out = F.when(kind == k, F.array(*[F.lit(c) for c in codes])).otherwise(out)
    return out


def truth_scorecard(occ: DataFrame, truths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(caught and total per kind, alerts and precision) of stored decisions.

    ``occ``: KEY, codes (any severity), max_severity, evaluated_at.
    """
    done = occ.filter("evaluated_at is not null")
    kinds = (
        truths.filter(F.col("kind").isin(list(fixed.EXPECTED_CODES)))
        .join(done, KEY)
        .groupBy("kind")
        .agg(F.count_if(F.arrays_overlap("codes", _kind_codes(F.col("kind")))).alias("caught"), F.count("*").alias("total"))
    )
    first = truths.agg(F.min("business_date"))
    flagged = truths.select(*KEY).distinct().withColumn("_true", F.lit(True))
    alerts = (
        done.filter(F.col("max_severity").isin(fixed.ALERT_SEVERITIES))
        .filter(F.col("business_date") >= first.scalar())
        .join(flagged, KEY, "left")
    )
    true = F.count_if(F.col("_true"))
    totals = alerts.agg(F.count("*").alias("alerts"), F.when(F.count("*") > 0, F.bround(true / F.count("*"), 3)).alias("precision"))
    return kinds, totals


def quality_scorecard(decisions: DataFrame, truths: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(recall by kind, totals, false alarms by code) of replayed decisions.

    A kind is caught by one of its codes at WARNING or worse, an unexpected delivery at any severity.
    """
    known = (
        truths.groupBy(*KEY)
        .agg(F.collect_set(F.when(~F.col("kind").isin(fixed.BENIGN_KINDS), F.col("kind"))).alias("kinds"), F.bool_or(F.col("kind") == "PARTIAL_HEALED").alias("healed"))
    )
    warn = F.transform(F.filter("findings", lambda f: f["severity"].isin(fixed.ALERT_SEVERITIES)), lambda f: f["code"])
    any_level = F.transform(
        F.filter("findings", lambda f: f["severity"].isin(fixed.ALERT_SEVERITIES) | (f["code"] == "UNEXPECTED_DELIVERY")), lambda f: f["code"]
    )
    d = (
        decisions.select(*KEY, F.array_distinct(warn).alias("warn"), F.array_distinct(any_level).alias("codes"))
        .join(known, KEY, "left")
        .withColumn("kinds", F.coalesce("kinds", F.array().cast("array<string>")))
    )
    alert, true = F.size("warn") > 0, F.size("kinds") > 0
    by_kind = (
        d.select("codes", F.explode("kinds").alias("kind"))
        .groupBy("kind")
        .agg(F.count_if(F.arrays_overlap("codes", _kind_codes(F.col("kind")))).alias("caught"), F.count("*").alias("total"))
    )
    n, a, t = F.count("*"), F.count_if(alert), F.count_if(alert & true)
    totals = d.agg(
        n.alias("occurrences"),
        a.alias("alerts"),
        t.alias("true_alerts"),
        F.when(a > 0, F.bround(t / a, 3)).otherwise(1.0).alias("precision"),
        F.bround(100 * (a - t) / F.greatest(n, F.lit(1)), 2).alias("false_alerts_per_100"),
        F.count_if(F.coalesce("healed", F.lit(False)) & F.array_contains("warn", "VOLUME_LOW")).alias("healed_still_alerting"),
    )
    false_codes = (
        d.filter(alert & ~true).select(F.explode("warn").alias("code")).groupBy("code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "code")
    )
    return by_kind, totals, false_codes
