"""Run the whole chain over past loads, and compare rule sets on them."""

from __future__ import annotations

from datetime import UTC, date, datetime, time, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import fixed
from tidewatch.functions.scalar import severity_rank
from tidewatch.operators.assign import assign_loads
from tidewatch.operators.contracts import contract_validity
from tidewatch.operators.evaluate import KEY, evaluate
from tidewatch.operators.metrics import build_occurrences
from tidewatch.operators.schedule import expand_schedule
from tidewatch.session import settle

SPILL = (fixed.LATE_LOOKBACK_DAYS, 2)
MATCH_PAD = timedelta(days=fixed.LATE_LOOKBACK_DAYS + 1)


def history_depth(contracts: DataFrame) -> int:
    """Deepest lookback of any contract (a small table), at least the common depth."""
    top = contracts.agg(F.max("learning.lookback_days")).first()[0]
    return max(int(top or 0), fixed.HISTORY_DAYS)


def warm_up(loads: DataFrame, start: date, depth: int) -> date:
    """First day whose deliveries a judgement on ``start`` may look at: one scalar of the loads."""
    earliest = loads.agg(F.to_date(F.min("received_at"))).first()[0]
    return min(start, max(earliest or start, start - timedelta(days=depth) - MATCH_PAD))


def replay_occurrences(
    loads: DataFrame, contracts: DataFrame, cal: DataFrame, first_day: date, end: date, now: datetime, use_hints: bool = True, earlier: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(occurrences, assigned loads) before judgement. Loads after ``now``, or too late for any delivery up to ``end``, are ignored.

    ``cal`` must cover first_day - 15 days to end + 15 days. ``earlier`` is the ``first_seen`` of loads left out of ``loads``.
    """
    last = datetime.combine(end + MATCH_PAD + timedelta(days=2), time.min, UTC)
    arrived = loads.filter((F.col("received_at") <= F.lit(now)) & (F.col("received_at") <= F.lit(last)))
    if not use_hints and "slot_hint" in arrived.columns:
        arrived = arrived.drop("slot_hint")
    validity = contract_validity(contracts)
    cand = settle(expand_schedule(validity, cal, first_day - MATCH_PAD, end + MATCH_PAD, SPILL), "candidates")
    # Matching is the costly step and several branches read it.
    assigned = settle(assign_loads(arrived, cand, validity), "assigned")
    expected = expand_schedule(validity, cal, first_day, end)
    return build_occurrences(expected, assigned, cand, earlier), assigned


def replay(
    loads: DataFrame,
    contracts: DataFrame,
    cal: DataFrame,
    start: date,
    end: date,
    now: datetime,
    labels: DataFrame | None = None,
    use_hints: bool = True,
    engine: str = "champion",
    first_day: date | None = None,
) -> DataFrame:
    """Decisions with business_date in [start, end]; earlier loads from ``first_day`` on only warm up history.

    Without ``first_day`` the warm-up begins with the earliest load, but not before the deepest lookback needs it.
    """
    depth = history_depth(contracts)
    if first_day is None:
        first_day = warm_up(loads, start, depth)
    occ, _ = replay_occurrences(loads, contracts, cal, first_day, end, now, use_hints)
    out = evaluate(settle(occ, "occurrences"), contracts, F.lit(now), labels, engine, depth)
    return out.filter(F.col("business_date").between(F.lit(start), F.lit(end)))


def alert_codes(findings: Column) -> Column:
    """Sorted distinct codes of WARNING or worse."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(findings, lambda f: severity_rank(f["severity"]) >= 2), lambda f: f["code"])))


def alerts(decisions: DataFrame) -> DataFrame:
    """(KEY, alerts array of (category, code), codes) of decisions that alert."""
    hits = F.filter("findings", lambda f: severity_rank(f["severity"]) >= 2)
    pairs = F.array_sort(F.array_distinct(F.transform(hits, lambda f: F.struct(f["category"].alias("category"), f["code"].alias("code")))))
    return (
        decisions.select(*KEY, pairs.alias("alerts"))
        .filter(F.size("alerts") > 0)
        .withColumn("codes", F.array_sort(F.transform("alerts", lambda a: a["code"])))
    )


def backtest_summary(alerted: DataFrame) -> DataFrame:
    """(code, n): alerting occurrences per code and in total (code null), most common first."""
    per = alerted.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    total = alerted.agg(F.count("*").alias("n")).select(F.lit(None).cast("string").alias("code"), "n")
    return per.unionByName(total).orderBy(F.desc("n"), "code")


def compare_alerts(candidate: DataFrame, current: DataFrame) -> DataFrame:
    """Occurrences whose alert codes differ."""
    empty = F.array().cast("array<string>")
    a = current.select(*KEY, F.col("codes").alias("current"))
    b = candidate.select(*KEY, F.col("codes").alias("candidate"))
    return (
        a.join(b, KEY, "full_outer")
        .withColumns({"current": F.coalesce("current", empty), "candidate": F.coalesce("candidate", empty)})
        .filter(F.col("current") != F.col("candidate"))
    )


def verdict_coverage(verdicts: DataFrame, candidate: DataFrame, current: DataFrame, start: date, end: date) -> DataFrame:
    """One row: confirmed incidents still caught and false alarms still raised by either rule set."""
    hit = lambda name: F.coalesce(F.exists(name, lambda a: a["category"] == F.col("category")), F.lit(False))
    v = (
        verdicts.filter(F.col("business_date").between(F.lit(start), F.lit(end)))
        .join(candidate.select(*KEY, F.col("alerts").alias("a_cand")), KEY, "left")
        .join(current.select(*KEY, F.col("alerts").alias("a_cur")), KEY, "left")
    )
    tp, fp = F.col("resolution") == "TRUE_POSITIVE", F.col("resolution").isin(fixed.NOISY_VERDICTS)
    return v.agg(
        F.count_if(tp).alias("true_positive_total"),
        F.count_if(tp & hit("a_cand")).alias("caught_by_candidate"),
        F.count_if(tp & hit("a_cur")).alias("caught_by_current"),
        F.count_if(fp).alias("false_alarm_total"),
        F.count_if(fp & hit("a_cand")).alias("false_alarms_remaining_candidate"),
        F.count_if(fp & hit("a_cur")).alias("false_alarms_remaining_current"),
    )


def run_backtest(
    candidate: DataFrame,
    current: DataFrame,
    loads: DataFrame,
    cal: DataFrame,
    labels: DataFrame | None,
    verdicts: DataFrame,
    start: date,
    end: date,
    now: datetime,
    first_day: date | None = None,
) -> dict[str, DataFrame]:
    """candidate and current summaries, verdict coverage and changed occurrences. Slot hints are not used."""
    args = {"labels": labels, "use_hints": False, "first_day": first_day}
    cand = settle(alerts(replay(loads, candidate, cal, start, end, now, **args)), "alerts")
    cur = settle(alerts(replay(loads, current, cal, start, end, now, **args)), "alerts")
    return {
        "candidate": backtest_summary(cand),
        "current": backtest_summary(cur),
        "verdicts": verdict_coverage(verdicts, cand, cur, start, end),
        "changes": compare_alerts(cand, cur),
    }
