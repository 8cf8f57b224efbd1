"""From findings to incidents: impact, priority, reconciliation, verdicts, outages and notifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewatch import fixed
from tidewatch.functions.scalar import demote, lookup, money, num, priority, severity_name, severity_rank
from tidewatch.operators.evaluate import KEY
from tidewatch.session import settle, spread

CASE = [*KEY, "category"]
WHOLE_DELIVERY = ["UNIT_SCALE_SUSPECT", "DUPLICATE_FILE", "NEGATIVE_AMOUNTS", "STALE_DATA", "LATE_DELIVERY"]


def finding_impact(code: Column, observed: Column, expected: Column) -> Column:
    """struct(customers, amount, basis) one finding stands for; ``metrics`` and ``reference`` are columns of the row."""
    share = F.greatest(F.lit(0.0), 1 - F.coalesce(observed, F.lit(0.0)) / expected)

    def lost(name: str) -> Column:
        return F.nullif(F.coalesce(F.col(f"reference.{name}"), F.lit(0.0)) * share, F.lit(0.0))

    def impact(customers: Column, amount: Column, basis: str) -> Column:
        return F.struct(customers.alias("customers"), amount.alias("amount"), F.lit(basis).alias("basis"))

    return (
        F.when(
            code.isin("MISSING_DELIVERY", "DELIVERY_AT_RISK"),
            impact(F.col("reference.customer_count"), F.col("reference.total_amount"), "expected_delivery"),
        )
        .when((code == "VOLUME_LOW") & (expected != 0), impact(lost("customer_count"), lost("total_amount"), "missing_share"))
        .when(code.isin(WHOLE_DELIVERY), impact(F.col("metrics.customer_count"), F.col("metrics.total_amount"), "whole_delivery"))
    )


def estimate_impact(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the impact with most customers, the first finding winning ties; null customers never win.

    ``findings`` is long, with metrics, reference and ord.
    """
    f = findings.withColumn("_i", finding_impact(F.col("code"), F.col("observed"), F.col("expected")))
    wins = F.coalesce(F.col("_i.customers"), F.lit(0.0)) > 0
    best = F.max_by(F.when(wins, F.col("_i")), F.when(wins, F.struct(F.col("_i.customers").alias("c"), (-F.col("ord")).alias("o"))))
    return (
        f.groupBy(*keys)
        .agg(best.alias("b"))
        .select(
            *keys,
            F.col("b.customers").alias("impact_customers"),
            F.col("b.amount").alias("impact_amount"),
            F.coalesce("b.basis", F.lit("none")).alias("impact_basis"),
        )
    )


def incident_title(institution: Column, slot_label: Column, codes: Column, business_date: Column) -> Column:
    """Codes are named in catalogue order."""
    order = F.array(*[F.lit(c) for c in fixed.CODE_TITLES])
    listed = F.filter(order, lambda c: F.array_contains(codes, c))
    unlisted = F.array_except(codes, order)
    names = F.transform(F.concat(listed, unlisted), lambda c: lookup(fixed.CODE_TITLES, c))
    return F.format_string("%s — %s: %s (%s)", institution, slot_label, F.array_join(names, ", "), F.date_format(business_date, "dd.MM.yyyy"))


def incident_candidates(decisions: DataFrame, institutions: DataFrame) -> DataFrame:
    """One row per (occurrence, category) with WARNING or worse findings.

    Only decisions that alert leave the scan, and their findings combine on the map side.
    """
    f = F.posexplode("findings").alias("ord", "f")
    long = (
        decisions.filter(F.exists("findings", lambda x: severity_rank(x["severity"]) >= 2))
        .select(*KEY, "slot_label", "metrics", "reference", f)
        .select(*KEY, "slot_label", "metrics", "reference", "ord", "f.*")
        .filter(F.col("severity").isin(fixed.ALERT_SEVERITIES))
    )
    impact = finding_impact(F.col("code"), F.col("observed"), F.col("expected"))
    i = F.col("_i")
    wins = F.coalesce(i["customers"], F.lit(0.0)) > 0
    grouped = (
        long.withColumns({"_i": impact, "_rank": severity_rank(F.col("severity"))})
        .groupBy(*CASE, "slot_label")
        .agg(
            F.array_sort(F.collect_set("code")).alias("codes"),
            severity_name(F.max("_rank")).alias("severity"),
            F.max_by(F.when(wins, i), F.when(wins, F.struct(i["customers"].alias("c"), (-F.col("ord")).alias("o")))).alias("b"),
        )
    )
    inst = institutions.select("institution", "tier")
    return grouped.join(inst, "institution").select(
        *CASE,
        "codes",
        "severity",
        "tier",
        F.col("b.customers").alias("impact_customers"),
        F.col("b.amount").alias("impact_amount"),
        F.coalesce("b.basis", F.lit("none")).alias("impact_basis"),
        priority(F.col("severity"), F.col("tier"), F.col("b.customers")).alias("priority"),
        incident_title(F.col("institution"), F.col("slot_label"), F.col("codes"), F.col("business_date")).alias("title"),
    )


def active_suppressions(suppressions: DataFrame, now: Column) -> DataFrame:
    return suppressions.filter((F.col("starts_at") <= now) & (F.col("ends_at") >= now))


def with_suppression(rows: DataFrame, suppressions: DataFrame, now: Column) -> DataFrame:
    """Adds suppression_id of an active interval of the institution, or of a global one.

    Two simple steps replace the OR in the condition: an equi join on institution, and one global value.
    """
    live = active_suppressions(suppressions, now)
    own = live.filter("institution is not null").groupBy("institution").agg(F.min("suppression_id").alias("_own"))
    everyone = live.filter("institution is null").agg(F.min("suppression_id"))
    return (
        rows.join(own, "institution", "left")
        .withColumn("suppression_id", F.coalesce(F.col("_own"), everyone.scalar()))
        .drop("_own")
    )


def last_resolution(resolved: DataFrame) -> DataFrame:
    """Newest resolved incident per (occurrence, category)."""
    return (
        resolved.filter(F.col("status") == "RESOLVED")
        .groupBy(*CASE)
        .agg(F.max_by(F.struct("codes", "resolution"), F.struct("resolved_at", "codes", "resolution")).alias("l"))
        .select(*CASE, F.col("l.codes").alias("last_codes"), F.col("l.resolution").alias("last_resolution"))
    )


def reconcile(
    open_incidents: DataFrame, candidates: DataFrame, resolved: DataFrame, suppressions: DataFrame, evaluated: DataFrame, now: Column
) -> tuple[DataFrame, DataFrame]:
    """(changes, events): what happens to each (occurrence, category) now.

    ``evaluated`` holds the KEYs judged in this run: only their incidents may clear.
    """
    o = open_incidents.select(
        *CASE, F.col("codes").alias("o_codes"), F.col("severity").alias("o_severity"), F.col("priority").alias("o_priority"), "parent_id", "incident_id"
    )
    o = o.join(evaluated.select(*KEY), KEY, "left_semi")
    both = o.join(candidates, CASE, "full_outer").join(last_resolution(resolved), CASE, "left")
    both = with_suppression(both, suppressions, now)
    old, new = F.col("incident_id").isNotNull(), F.col("codes").isNotNull()
    differs = (F.col("codes") != F.col("o_codes")) | (F.col("severity") != F.col("o_severity"))
    decided = (
        F.col("last_codes").isNotNull()
        & (F.size(F.array_except("codes", "last_codes")) == 0)
        & ~F.col("last_resolution").eqNullSafe(F.lit("AUTO_CLEARED"))
    )
    action = (
        F.when(old & new, F.when(differs, "UPDATED").otherwise("UNCHANGED"))
        .when(old, "AUTO_RESOLVED")
        .when(decided, "ALREADY_DECIDED")
        .when(F.col("suppression_id").isNotNull(), "SUPPRESSED")
        .otherwise("OPENED")
    )
    updated = F.col("action") == "UPDATED"
    child = F.col("parent_id").isNotNull()
    closed = F.col("action").isin("AUTO_RESOLVED", "SUPPRESSED")
    opened = F.col("action").isin("OPENED", "SUPPRESSED")
    keeps = F.col("action").isin("UNCHANGED", "AUTO_RESOLVED")
    changes = both.withColumn("action", action).select(
        *CASE,
        "incident_id",
        "parent_id",
        "action",
        F.when(keeps, F.col("o_codes")).otherwise(F.col("codes")).alias("codes"),
        F.col("o_codes").alias("previous_codes"),
        F.when(keeps, F.col("o_severity")).otherwise(F.col("severity")).alias("severity"),
        F.when(keeps, F.col("o_priority")).when(updated & child, demote(F.col("priority"))).otherwise(F.col("priority")).alias("priority"),
        F.when(closed, "RESOLVED").otherwise("OPEN").alias("status"),
        F.when(F.col("action") == "AUTO_RESOLVED", "AUTO_CLEARED").when(F.col("action") == "SUPPRESSED", "SUPPRESSED").alias("resolution"),
        F.when(opened, now).alias("opened_at"),
        F.when(closed, now).alias("resolved_at"),
        F.when(F.col("action") == "SUPPRESSED", F.col("suppression_id")).alias("suppressed_by"),
        *[c for c in ("title", "impact_customers", "impact_amount") if c in candidates.columns],
    )
    kinds = F.when(F.col("action") == "SUPPRESSED", F.array(F.lit("OPENED"), F.lit("SUPPRESSED"))).otherwise(F.array("action"))
    events = changes.filter(F.col("action").isin("OPENED", "SUPPRESSED", "UPDATED", "AUTO_RESOLVED")).select(
        *CASE, F.explode(kinds).alias("kind"), now.alias("at"), F.lit("system").alias("actor"), "codes", "previous_codes"
    )
    return changes.filter(F.col("action") != "ALREADY_DECIDED"), events


def apply_verdicts(incidents: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(incidents after the verdicts, labels for learning, refused verdicts).

    ``verdicts``: incident_id, actor, resolution, note, at. A verdict on a systemic parent closes its
    open children with the same resolution. Incidents without a parent are dealt by their ids in the join
    with parents, as all nulls would meet in one task, and no small shuffles are merged before they are sorted.
    """
    incidents = spread(incidents, "incident_id")
    v = verdicts.join(incidents.select("incident_id", "status", "kind"), "incident_id", "left")
    noted = F.length(F.trim(F.coalesce("note", F.lit("")))) > 0
    problem = (
        F.when(F.col("status").isNull(), "unknown_incident")
        .when(~F.col("resolution").isin(fixed.ANALYST_VERDICTS), "unknown_resolution")
        .when(F.col("resolution").isin(fixed.NOTE_REQUIRED) & ~noted, "note_required")
        .when(F.col("status") == "RESOLVED", "already_resolved")
    )
    v = v.withColumn("error", problem)
    errors = v.filter("error is not null").select("incident_id", "actor", "resolution", "error")
    one = (
        v.filter("error is null")
        .groupBy("incident_id")
        .agg(F.min_by(F.struct("resolution", "note", "actor", "at", "kind"), "at").alias("v"))
        .select("incident_id", "v.*")
    )
    own = one.select("incident_id", F.col("resolution").alias("v_res"), F.col("actor").alias("v_by"), F.col("at").alias("v_at"))
    parents = one.filter("kind = 'SYSTEMIC'").select(
        F.col("incident_id").alias("parent_id"), F.col("resolution").alias("p_res"), F.col("actor").alias("p_by"), F.col("at").alias("p_at")
    )
    place = lambda key: F.xxhash64(key.cast("string"))
    joined = (
        incidents.join(own, "incident_id", "left")
        .withColumn("_place", place(F.coalesce("parent_id", "incident_id")))
        .join(parents.withColumn("_place", place(F.col("parent_id"))), ["parent_id", "_place"], "left")
    )
    live = F.col("status") != "RESOLVED"
    res = F.when(live, F.coalesce("v_res", "p_res"))
    out = joined.withColumn("_res", res).withColumns(
        {
            "resolution": F.coalesce("_res", "resolution"),
            "resolved_at": F.when(F.col("_res").isNotNull(), F.coalesce("v_at", "p_at")).otherwise(F.col("resolved_at")),
            "resolved_by": F.when(F.col("_res").isNotNull(), F.coalesce("v_by", "p_by")),
            "closed_now": F.col("_res").isNotNull(),
            "status": F.when(F.col("_res").isNotNull(), "RESOLVED").otherwise(F.col("status")),
        }
    )
    teaches = (
        F.when(F.col("resolution").isin("TRUE_POSITIVE", "EXPECTED_EVENT") & F.col("category").isin("VOLUME", "QUALITY", "RULE"), "EXCLUDE")
        .when(F.col("resolution") == "NEW_NORMAL", "REGIME")
    )
    labels = (
        out.filter(F.col("closed_now") & F.col("business_date").isNotNull())
        .select(*KEY, teaches.alias("label"))
        .filter("label is not null")
        .groupBy(*KEY)
        .agg(F.max("label").alias("label"))  # REGIME sorts after EXCLUDE and wins
    )
    return out.select(*incidents.columns, "resolved_by", "closed_now"), labels, errors


# --- outages across institutions ---------------------------------------------------------------------


def systemic_signal(due: Column, missing: Column) -> Column:
    return (missing >= fixed.SYSTEMIC_MIN_MISSING) & (missing / F.greatest(due, F.lit(1)) >= fixed.SYSTEMIC_MIN_SHARE)


def detect_systemic(occ: DataFrame, now: Column) -> DataFrame:
    """At most one row: many deliveries due in the last 90 minutes are missing."""
    since = now - F.expr(f"interval {fixed.SYSTEMIC_WINDOW_MIN} minutes")
    missing = F.col("status") == "MISSING"
    return (
        occ.filter(F.col("expected") & F.col("deadline_utc").between(since, now))
        .agg(F.count("*").alias("due"), F.count_if(missing).alias("missing"))
        .filter(systemic_signal(F.col("due"), F.col("missing")))
        .select(since.alias("window_start"), now.alias("window_end"), "due", "missing", (F.col("missing") / F.col("due")).alias("share"))
    )


def scan_systemic(occ: DataFrame, minutes: int = fixed.SYSTEMIC_WINDOW_MIN) -> DataFrame:
    """Every past deadline instant at which the signal would have been raised.

    At instant t a delivery counts when its deadline lies in the ``minutes`` up to t, and as missing when its first file
    came after t or never. So a delivery adds one at its deadline and takes it away after the window, or as missing when
    its file comes. The sums at t are running sums of these changes, summed per instant first: one pass over the sorted
    instants in range partitions, each after the total of those before. There is no join, and a deadline that all
    deliveries share is one row.
    """
    window = minutes * 60_000_000
    dl, came = F.unix_micros("deadline_utc"), F.unix_micros("first_received_at")
    end = dl + window + 1  # the first instant at which the deadline is too old
    until = F.when(came.isNull() | (came > end), end).otherwise(F.greatest(came, dl))
    step = lambda at, due, missing, asked: F.struct(at.alias("t"), F.lit(due).alias("due"), F.lit(missing).alias("missing"), F.lit(asked).alias("asked"))
    steps = F.array(step(dl, 1, 1, 1), step(until, 0, -1, 0), step(end, -1, 0, 0))
    per = (
        occ.filter("expected")
        .select(F.explode(steps).alias("s"))
        .groupBy("s.t")
        .agg(F.sum("s.due").alias("due"), F.sum("s.missing").alias("missing"), F.max("s.asked").alias("asked"))
    )
    ordered = running_sums(per, "t", ["due", "missing"])
    return ordered.filter((F.col("asked") == 1) & systemic_signal(F.col("due"), F.col("missing"))).select(F.timestamp_micros("t").alias("at"), "due", "missing")


def running_sums(rows: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """``columns`` as sums up to each row in ``order`` (unique values), without one task for all rows.

    Rows are dealt to ranges and written; each range is summed on its own, and the few totals of the ranges before are added.
    """
    dealt = rows.repartitionByRange(order).withColumn("_range", F.spark_partition_id())
    dealt = settle(dealt, "ranges")
    totals = dealt.groupBy("_range").agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # one row per range
    offsets = totals.select("_range", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in columns])
    within = W.partitionBy("_range").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    sums = {c: F.sum(c).over(within) + F.col(f"_{c}") for c in columns}
    return dealt.join(offsets, "_range").withColumns(sums).drop("_range", *[f"_{c}" for c in columns])


def group_systemic(signal: DataFrame, incidents: DataFrame, occ: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(parent row to open, incidents with children linked).

    Open incidents of the missing deliveries that have no parent yet get one and lose one priority step. The parent's id
    follows from its fingerprint, so a later run on the result finds the day's parent and its children and changes nothing.
    """
    parent_key = F.concat(F.lit("systemic:"), F.date_format(F.from_utc_timestamp(now, fixed.DEFAULT_TIMEZONE), "yyyy-MM-dd"))
    id_type = incidents.schema["incident_id"].dataType
    parent_id = F.abs(F.xxhash64(parent_key)).cast(id_type)
    # At most one row: what is open today under this id.
    there = incidents.filter((F.col("incident_id") == parent_id) & (F.col("status") != "RESOLVED")).agg(F.count("*")).scalar()
    parent = signal.select(
        parent_id.alias("incident_id"),
        parent_key.alias("fingerprint"),
        F.lit("SYSTEMIC").alias("kind"),
        F.lit("TIMELINESS").alias("category"),
        F.array(F.lit("SYSTEMIC_OUTAGE")).alias("codes"),
        F.lit("CRITICAL").alias("severity"),
        F.lit("P1").alias("priority"),
        F.format_string(
            "Toplu teslimat kesintisi: %d kurumdan dosya gelmedi (%s)",
            "missing",
            F.date_format(F.from_utc_timestamp(now, fixed.DEFAULT_TIMEZONE), "dd.MM.yyyy"),
        ).alias("title"),
        now.alias("opened_at"),
    )
    since = now - F.expr(f"interval {fixed.SYSTEMIC_WINDOW_MIN} minutes")
    hit = occ.filter(F.col("expected") & F.col("deadline_utc").between(since, now) & (F.col("status") == "MISSING")).select(*KEY)
    # The parent is at most one row; without a signal the value is null and every incident stays as it is.
    marked = hit.withColumn("systemic_parent", parent.agg(F.max("fingerprint")).scalar())
    joined = incidents.join(marked, KEY, "left")
    link = F.col("systemic_parent").isNotNull() & (F.col("status") != "RESOLVED") & F.col("parent_id").isNull()
    linked = joined.withColumn("linked", link).withColumns(
        {
            "priority": F.when(F.col("linked"), demote(F.col("priority"))).otherwise(F.col("priority")),
            "parent_id": F.when(F.col("linked"), parent_id.cast(incidents.schema["parent_id"].dataType)).otherwise(F.col("parent_id")),
            "systemic_parent": F.when(F.col("linked"), F.col("systemic_parent")),
        }
    )
    return parent.filter(there == 0), linked


# --- texts for people -----------------------------------------------------------------------------------


def describe_impact(customers: Column, amount: Column) -> Column:
    some = F.coalesce(customers, F.lit(0.0)) != 0
    tail = F.when(F.coalesce(amount, F.lit(0.0)) != 0, F.concat(F.lit(", ~"), money(amount), F.lit(" borç"))).otherwise("")
    return F.when(some, F.concat(F.lit("~"), num(customers), F.lit(" müşteri"), tail))


def select_notifications(incidents: DataFrame, now: Column, base_url: str) -> DataFrame:
    """P1/P2 incidents older than two minutes, still open and not grouped under a parent."""
    due = F.col("opened_at") <= now - F.expr(f"interval {fixed.NOTIFY_DELAY_MIN} minutes")
    systemic = F.col("kind") == "SYSTEMIC"
    impact = F.coalesce(F.concat(F.lit(" — Etki: "), describe_impact(F.col("impact_customers"), F.col("impact_amount"))), F.lit(""))
    return incidents.filter(
        F.col("priority").isin("P1", "P2") & (F.col("status") != "RESOLVED") & F.col("parent_id").isNull() & (due | systemic)
    ).select(
        "incident_id",
        "priority",
        F.concat(
            F.format_string("[%s] #%s %s", "priority", F.col("incident_id").cast("string"), "title"),
            impact,
            F.lit(f"\n{base_url}/incidents/"),
            F.col("incident_id").cast("string"),
        ).alias("text"),
    )
