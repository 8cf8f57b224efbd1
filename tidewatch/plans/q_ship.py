"""Queries over deliveries made of line items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch import fixed
from tidewatch.functions.quantiles import group_effects, grouped_median, mad
from tidewatch.operators import governance as gov
from tidewatch.operators import readmodels as rm
from tidewatch.operators.assign import assign_loads
from tidewatch.operators.baseline import volume_baselines, watched_values
from tidewatch.operators.contracts import contract_validity
from tidewatch.operators.detectors.messages import with_messages
from tidewatch.operators.evaluate import ENGINES, actionable_findings, attach_spec, explode_findings, learn
from tidewatch.operators.history import is_point, with_history
from tidewatch.operators.incidents import estimate_impact, incident_candidates
from tidewatch.operators.metrics import aggregate_metrics, build_occurrences, first_seen, seen_before
from tidewatch.operators.replay import SPILL, alerts, backtest_summary, compare_alerts, replay, run_backtest, verdict_coverage
from tidewatch.operators.schedule import expand_schedule
from tidewatch.plans import domain as D
from tidewatch.plans import sqltext as S
from tidewatch.plans.registry import query, stored


def cal(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf, "calendar", lambda: D.calendar(spark))


def loads(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf, "ship_loads", lambda: D.ship_loads(spark, sf))


def expected(spark: SparkSession, sf: str) -> DataFrame:
    v = contract_validity(D.ship_contracts(spark, sf))
    return stored(spark, sf, "ship_expected", lambda: expand_schedule(v, cal(spark, sf), D.FIRST_DAY, D.END))


def assigned(spark: SparkSession, sf: str) -> DataFrame:
    def build() -> DataFrame:
        v = contract_validity(D.ship_contracts(spark, sf))
        return assign_loads(loads(spark, sf), expand_schedule(v, cal(spark, sf), D.FIRST_DAY, D.END, SPILL), v)

    return stored(spark, sf, "ship_assigned", build)


def labels(spark: SparkSession, sf: str) -> DataFrame:
    return D.ship_labels(expected(spark, sf), D.institutions(spark, sf))


def learned(spark: SparkSession, sf: str) -> DataFrame:
    def build() -> DataFrame:
        occ = build_occurrences(expected(spark, sf), assigned(spark, sf))
        return learn(attach_spec(occ, D.ship_contracts(spark, sf)), labels(spark, sf))

    return stored(spark, sf, "ship_learned", build)


def decisions(spark: SparkSession, sf: str, engine: str = "champion") -> DataFrame:
    return stored(spark, sf, f"ship_decisions_{engine}", lambda: ENGINES[engine](learned(spark, sf), F.lit(D.NOW)))


def r6(c: str | Column, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 6).alias(name or c.split(".")[-1])


OCC = ["institution", "business_date"]


# --- files and metrics ------------------------------------------------------------------------------


@query(
    "summarize_records",
    f"WITH {S.SHIP_FILES} SELECT institution, bd, part, record_count, total_amount::DOUBLE AS total_amount, customer_count, "
    "zero_amount_count, negative_amount_count, duplicate_record_count, max_amount::DOUBLE AS max_amount, content_hash FROM ship_files",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    f = D.ship_files(spark, sf)
    return f.drop("nk").withColumns({c: F.col(c).cast("double") for c in ("total_amount", "max_amount")})


@query(
    "assign_loads",
    f"WITH {S.SHIP_LOADS} SELECT institution, load_id, bd AS business_date, CASE WHEN rn > 1 THEN 'ADDITIONAL' WHEN minute < 360 THEN 'EARLY' "
    "WHEN minute <= 600 THEN 'ON_TIME' ELSE 'LATE' END AS reason FROM "
    "(SELECT *, row_number() OVER (PARTITION BY institution, bd ORDER BY received_at, load_id) AS rn FROM ship_loads)",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return assigned(spark, sf).select("institution", "load_id", "business_date", "reason")


METRICS = ", ".join(f"round({m}, 6) AS {m}" for m in fixed.METRIC_FIELDS)


@query("aggregate_metrics", f"WITH {S.SHIP_OCC} SELECT institution, bd AS business_date, {METRICS}, minute::INTEGER AS first_minute FROM ship_agg")
def _(spark: SparkSession, sf: str) -> DataFrame:
    m = aggregate_metrics(assigned(spark, sf))
    first = (F.hour("first_received_at") * 60 + F.minute("first_received_at")).alias("first_minute")
    return m.select(*OCC, *[r6(f"metrics.{x}") for x in fixed.METRIC_FIELDS], first)


@query(
    "occurrence_loads",
    f"WITH {S.SHIP_OCC} SELECT e.institution, e.bd AS business_date, coalesce(a.file_count, 0)::BIGINT AS load_count, e.phase AS month_phase, "
    "coalesce(g.dup, false) AS repeated FROM ship_exp e LEFT JOIN ship_agg a ON a.institution = e.institution AND a.bd = e.bd "
    "LEFT JOIN ship_got g ON g.institution = e.institution AND g.bd = e.bd",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    occ = build_occurrences(expected(spark, sf), assigned(spark, sf))
    return occ.select(*OCC, "load_count", "month_phase", F.col("dup_load_id").isNotNull().alias("repeated"))


@query(
    "seen_hash_join",
    f"WITH {S.SHIP_OCC} SELECT l.institution, l.load_id, date_diff('minute', s.seen_at, l.received_at)::BIGINT AS minutes_since FROM ship_loads l "
    "JOIN ship_seen s ON l.institution = s.institution AND l.content_hash = s.content_hash WHERE l.received_at > s.seen_at",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    gap = ((F.unix_timestamp("received_at") - F.unix_timestamp("first_seen_at")) / 60).cast("bigint")
    return seen_before(loads(spark, sf)).select("institution", "load_id", gap.alias("minutes_since"))


@query("first_seen_hash", f"WITH {S.SHIP_OCC} SELECT institution, content_hash, epoch(seen_at)::BIGINT AS first_seen FROM ship_seen")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return first_seen(loads(spark, sf)).select("institution", "content_hash", F.unix_timestamp("first_seen_at").alias("first_seen"))


# --- history ------------------------------------------------------------------------------------------


@query(
    "previous_delivery",
    f"WITH RECURSIVE {S.SHIP_OCC} SELECT institution, bd AS business_date, prev_bd, CASE WHEN prev_bd IS NOT NULL THEN round(p_amt, 2) END AS prev_amount, "
    "stale FROM ship_stale",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    got = learned(spark, sf).filter("load_count > 0")
    return got.select(*OCC, F.col("prev.business_date").alias("prev_bd"), F.round("prev.metrics.total_amount", 2).alias("prev_amount"), "stale")


@query(
    "history_frame",
    f"WITH RECURSIVE {S.SHIP_UNIT} SELECT e.institution, e.bd AS business_date, count(p.bd)::INTEGER AS points, coalesce(sum(p.record_count), 0.0) AS records, "
    "min(p.bd) AS oldest FROM ship_exp e LEFT JOIN ship_pts p ON p.institution = e.institution AND p.bd < e.bd AND p.bd >= e.bd - 400 GROUP BY ALL",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    h = with_history(learned(spark, sf), F.when(is_point(), F.struct("business_date", F.col("metrics.record_count").alias("n"))))
    total = F.aggregate("history.n", F.lit(0.0), lambda a, x: a + x)
    return h.select(*OCC, F.size("history").alias("points"), total.alias("records"), F.get("history.business_date", F.lit(0)).alias("oldest"))


@query(
    "arrival_profile",
    f"WITH RECURSIVE {S.SHIP_UNIT}, {S.SHIP_PROFILE} SELECT institution, bd AS business_date, round(median, 6) AS median, round(p90, 6) AS p90, "
    "round(p97, 6) AS p97, n::INTEGER AS n FROM ship_arr",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = learned(spark, sf).filter("arrival is not null")
    return rows.select(*OCC, r6("arrival.median"), r6("arrival.p90"), r6("arrival.p97"), "arrival.n")


@query(
    "reference_metrics",
    f"WITH RECURSIVE {S.SHIP_UNIT}, {S.SHIP_REFERENCE} SELECT institution, bd AS business_date, round(record_count, 6) AS record_count, "
    "round(total_amount, 6) AS total_amount, round(customer_count, 6) AS customer_count FROM ship_ref",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = learned(spark, sf).filter("reference is not null")
    return rows.select(*OCC, *[r6(f"reference.{m}") for m in fixed.REFERENCE_METRICS])


@query(
    "unit_reference",
    f"WITH RECURSIVE {S.SHIP_UNIT} SELECT institution, bd AS business_date, round(unit_ref, 6) AS unit_reference, unit_n::INTEGER AS unit_n, suspect, excluded FROM ship_pts",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    got = learned(spark, sf).filter("load_count > 0")
    n = F.when(F.col("unit_reference").isNull(), 0).otherwise(F.col("unit_n")).alias("unit_n")
    return got.select(*OCC, r6("unit_reference"), n, F.col("unit_factor").isNotNull().alias("suspect"), "excluded")


def baselines(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf, "ship_baselines", lambda: volume_baselines(learned(spark, sf), watched_values()))


@query(
    "volume_baseline",
    f"WITH RECURSIVE {S.SHIP_BASELINE} SELECT institution, bd AS business_date, metric, round(center, 6) AS center_log, round(scale, 6) AS scale_log, "
    "n::INTEGER AS n, round(ln(1 + level), 6) AS level_log, round(noise_pct, 4) AS noise_pct FROM bl",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    b = baselines(spark, sf)
    return b.select(
        *OCC, "metric", r6("center_log"), r6("scale_log"), F.col("n").cast("int").alias("n"), r6(F.log1p("level"), "level_log"), F.round("noise_pct", 4).alias("noise_pct")
    )


@query(
    "theil_sen",
    f"WITH RECURSIVE {S.SHIP_BASELINE} SELECT institution, bd AS business_date, metric, round(trend_per_30d, 6) AS trend_per_30d FROM bl",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return baselines(spark, sf).select(*OCC, "metric", r6("trend_per_30d"))


@query(
    "annual_drift",
    f"WITH RECURSIVE {S.SHIP_BASELINE} SELECT institution, bd AS business_date, metric, round(annual_factor, 6) AS annual_factor FROM bl",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return baselines(spark, sf).select(*OCC, "metric", r6("annual_factor"))


@query(
    "recent_level",
    f"WITH RECURSIVE {S.SHIP_BASELINE} SELECT institution, bd AS business_date, metric, round(ln(1 + level), 6) AS level_log FROM bl",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return baselines(spark, sf).select(*OCC, "metric", r6(F.log1p("level"), "level_log"))


@query(
    "record_mad",
    f"WITH {S.SHIP_RECORDS}, m AS (SELECT institution, median(amount::DOUBLE) AS m FROM ship_rec GROUP BY 1) "
    "SELECT r.institution, round(any_value(m.m), 4) AS median_amount, round(median(abs(amount::DOUBLE - m.m)), 4) AS mad FROM ship_rec r JOIN m USING (institution) GROUP BY 1",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rec = D.ship_records(spark, sf).select("institution", F.col("amount").cast("double").alias("x"))
    med = grouped_median(rec, ["institution"], F.col("x"), 500.0, "median_amount")
    dev = mad(rec, ["institution"], "x", 500.0)
    return med.join(dev, "institution").select("institution", F.round("median_amount", 4).alias("median_amount"), F.round("mad", 4).alias("mad"))


@query(
    "group_effects",
    f"WITH RECURSIVE {S.SHIP_OCC} SELECT institution, phase AS month_phase, round(median(record_count), 6) AS effect, count(*) AS n FROM ship_got "
    "GROUP BY ALL HAVING count(*) >= 3",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    d = learned(spark, sf).filter("load_count > 0").select("institution", "month_phase", F.col("metrics.record_count").alias("r"))
    return group_effects(d, ["institution"], "month_phase", "r", 5.0).select("institution", "month_phase", r6("effect"), "n")


# --- detectors ------------------------------------------------------------------------------------------

TIMELY = f"""{S.SHIP_UNIT}, {S.SHIP_PROFILE},
tl AS (SELECT a.institution, a.bd, CASE WHEN a.file_count IS NULL THEN 'MISSING' WHEN a.minute > 600 THEN 'LATE' ELSE 'RECEIVED' END AS status,
   CASE WHEN a.file_count IS NULL THEN 'MISSING_DELIVERY' WHEN a.minute > 600 THEN 'LATE_DELIVERY' WHEN a.minute < 360 THEN 'EARLY_DELIVERY'
      WHEN a.minute > r.p97 + 30 THEN 'ARRIVAL_DRIFT' END AS code,
   CASE WHEN a.file_count IS NULL THEN 'CRITICAL' WHEN a.minute > 600 THEN 'WARNING' WHEN a.minute < 360 OR a.minute > r.p97 + 30 THEN 'INFO' END AS severity,
   CASE WHEN a.minute > 600 THEN (a.minute - 600)::DOUBLE WHEN a.minute >= 360 AND a.minute > r.p97 + 30 THEN a.minute::DOUBLE END AS observed
   FROM ship_all a LEFT JOIN ship_arr r ON r.institution = a.institution AND r.bd = a.bd)"""

QUALITY = """
ql AS (SELECT institution, bd, 'DUPLICATE_FILE' AS code, 'CRITICAL' AS severity, CAST(NULL AS VARCHAR) AS metric, 'QUALITY' AS category FROM ship_pts WHERE dup
   UNION ALL SELECT institution, bd, 'STALE_DATA', 'WARNING', NULL, 'QUALITY' FROM ship_pts WHERE stale
   UNION ALL SELECT institution, bd, 'UNIT_SCALE_SUSPECT', 'CRITICAL', 'avg_amount', 'QUALITY' FROM ship_pts WHERE suspect
   UNION ALL SELECT institution, bd, 'ZERO_AMOUNT_RECORDS', CASE WHEN zero_amount_ratio > 3 * 0.05::DOUBLE THEN 'CRITICAL' ELSE 'WARNING' END, 'zero_amount_ratio', 'QUALITY'
      FROM ship_pts WHERE zero_amount_ratio > 0.05
   UNION ALL SELECT institution, bd, 'NEGATIVE_AMOUNTS', 'CRITICAL', 'negative_amount_count', 'QUALITY' FROM ship_pts WHERE negative_amount_count > 0
   UNION ALL SELECT institution, bd, 'DUPLICATE_RECORDS', 'WARNING', 'duplicate_record_ratio', 'QUALITY' FROM ship_pts WHERE duplicate_record_ratio > 0.01)"""


def limit_sql(cap: float, name: str = "lm") -> str:
    return f"""
{name} AS (SELECT institution, bd, 'LIMIT_BREACH' AS code, 'WARNING' AS severity, 'total_amount' AS metric, 'RULE' AS category, total_amount AS observed
   FROM ship_pts WHERE total_amount < 1 OR total_amount > {cap})"""


def volume_sql(bl: str = "bl", name: str = "vl") -> str:
    return f"""
{name}0 AS (SELECT b.institution, b.bd, b.metric, b.k, b.center, b.scale, CASE b.metric WHEN 'avg_amount' THEN p.avg_amount ELSE p.total_amount END AS v,
   p.dup, p.stale, p.suspect FROM {bl} b JOIN ship_pts p ON p.institution = b.institution AND p.bd = b.bd),
{name} AS (SELECT institution, bd, CASE WHEN z < 0 THEN 'VOLUME_LOW' ELSE 'VOLUME_HIGH' END AS code,
   CASE WHEN (z < 0 AND v / (exp(center) - 1) < 0.5) OR (z > 0 AND v / (exp(center) - 1) > 2) THEN 'CRITICAL' ELSE 'WARNING' END AS severity,
   metric, 'VOLUME' AS category, z, v, exp(center) - 1 AS expected
   FROM (SELECT *, (ln(1 + greatest(v, 0.0)) - center) / scale AS z FROM {name}0)
   WHERE (z < -k AND metric = 'avg_amount' OR z > k) AND NOT dup AND NOT stale AND NOT suspect)"""


@query(
    "detect_timeliness",
    f"WITH RECURSIVE {TIMELY} SELECT institution, bd AS business_date, status, code, severity, round(observed, 6) AS observed FROM tl",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    d = decisions(spark, sf)
    f = F.get(F.filter("findings", lambda x: x["category"] == "TIMELINESS"), F.lit(0))
    return d.select(*OCC, "status", f["code"].alias("code"), f["severity"].alias("severity"), r6(f["observed"], "observed"))


@query("detect_quality", f"WITH RECURSIVE {S.SHIP_UNIT}, {QUALITY} SELECT institution, bd AS business_date, code, severity, metric FROM ql")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return explode_findings(decisions(spark, sf)).filter("category = 'QUALITY'").select(*OCC, "code", "severity", "metric")


def _quality_code(code: str) -> None:
    @query(
        code.lower(),
        f"WITH RECURSIVE {S.SHIP_UNIT}, {QUALITY} SELECT q.institution, q.bd AS business_date, q.severity, round(CASE q.metric WHEN 'avg_amount' THEN p.avg_amount "
        "WHEN 'zero_amount_ratio' THEN p.zero_amount_ratio WHEN 'negative_amount_count' THEN p.negative_amount_count "
        f"WHEN 'duplicate_record_ratio' THEN p.duplicate_record_ratio END, 6) AS observed FROM ql q JOIN ship_pts p USING (institution, bd) WHERE q.code = '{code}'",
    )
    def _(spark: SparkSession, sf: str) -> DataFrame:
        f = explode_findings(decisions(spark, sf)).filter(F.col("code") == code)
        return f.select(*OCC, "severity", r6("observed"))


for _code in ("DUPLICATE_FILE", "STALE_DATA", "UNIT_SCALE_SUSPECT", "ZERO_AMOUNT_RECORDS", "NEGATIVE_AMOUNTS", "DUPLICATE_RECORDS"):
    _quality_code(_code)


@query(
    "detect_limits",
    f"WITH RECURSIVE {S.SHIP_UNIT}, {limit_sql(250000)} SELECT institution, bd AS business_date, severity, round(observed, 2) AS observed FROM lm",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    f = explode_findings(decisions(spark, sf)).filter("code = 'LIMIT_BREACH'")
    return f.select(*OCC, "severity", F.round("observed", 2).alias("observed"))


@query(
    "detect_volume",
    f"WITH RECURSIVE {S.SHIP_BASELINE}, {volume_sql()} SELECT institution, bd AS business_date, code, severity, metric, round(z, 5) AS score FROM vl",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    f = explode_findings(decisions(spark, sf)).filter("code in ('VOLUME_LOW', 'VOLUME_HIGH')")
    return f.select(*OCC, "code", "severity", "metric", F.round("score", 5).alias("score"))


FOUND = f"""{S.SHIP_BASELINE}, {TIMELY[len(S.SHIP_UNIT) + 2:]}, {QUALITY}, {limit_sql(250000)}, {volume_sql()},
found AS (SELECT institution, bd, code, severity, 'TIMELINESS' AS category, 1 AS o, NULL AS expected, observed AS obs FROM tl WHERE code IS NOT NULL
   UNION ALL SELECT institution, bd, code, severity, category, 2, NULL, NULL FROM ql
   UNION ALL SELECT institution, bd, code, severity, category, 3, expected, v FROM vl
   UNION ALL SELECT institution, bd, code, severity, category, 4, NULL, observed FROM lm),
ranked AS (SELECT *, CASE severity WHEN 'CRITICAL' THEN 3 WHEN 'WARNING' THEN 2 ELSE 1 END AS r FROM found)"""
TOP = "CASE max(r) WHEN 3 THEN 'CRITICAL' WHEN 2 THEN 'WARNING' WHEN 1 THEN 'INFO' END"


@query(
    "replay",
    f"WITH RECURSIVE {FOUND} SELECT t.institution, t.bd AS business_date, t.status, "
    f"coalesce(string_agg(f.code, ',' ORDER BY f.code), '') AS codes, {TOP} AS max_severity "
    "FROM tl t LEFT JOIN ranked f ON f.institution = t.institution AND f.bd = t.bd WHERE t.bd >= DATE '1995-03-01' GROUP BY t.institution, t.bd, t.status",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    d = replay(
        loads(spark, sf), D.ship_contracts(spark, sf), cal(spark, sf), D.START, D.END, D.NOW, labels(spark, sf), first_day=D.FIRST_DAY
    )
    codes = F.array_join(F.array_sort(F.transform("findings", lambda f: f["code"])), ",")
    return d.select(*OCC, "status", codes.alias("codes"), "max_severity")


@query(
    "evaluate",
    f"WITH RECURSIVE {FOUND} SELECT t.status, f.code, f.severity, count(*) AS n FROM tl t JOIN ranked f ON f.institution = t.institution AND f.bd = t.bd GROUP BY ALL",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return explode_findings(decisions(spark, sf), "status").groupBy("status", "code", "severity").agg(F.count("*").alias("n"))


@query(
    "actionable_findings",
    f"WITH RECURSIVE {FOUND} SELECT institution, category, code, count(*) AS n FROM ranked WHERE r >= 2 GROUP BY ALL",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    f = actionable_findings(explode_findings(decisions(spark, sf)))
    return f.groupBy("institution", "category", "code").agg(F.count("*").alias("n"))


@query("max_severity", f"WITH RECURSIVE {FOUND} SELECT institution, bd AS business_date, {TOP} AS max_severity FROM ranked GROUP BY ALL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return decisions(spark, sf).filter("max_severity is not null").select(*OCC, "max_severity")


@query("finding_messages")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return with_messages(decisions(spark, sf)).select(*OCC, "ord", "code", "severity", "message")


MIX = {
    "records_per_customer": ("record_count / nullif(customer_count, 0)", 4.0),
    "amount_per_record": ("total_amount / nullif(record_count, 0)", 4.0),
}
MIX_SQL = f"{S.SHIP_UNIT}, {S.baseline(MIX)}"
MIX_FOUND = """
mx AS (SELECT institution, bd, metric, z FROM (SELECT b.*, (ln(1 + greatest(CASE b.metric WHEN 'records_per_customer' THEN p.record_count / nullif(p.customer_count, 0)
   ELSE p.total_amount / nullif(p.record_count, 0) END, 0.0)) - b.center) / b.scale AS z
   FROM bl b JOIN ship_pts p ON p.institution = b.institution AND p.bd = b.bd) WHERE abs(z) > k)"""


@query(
    "detect_mix_shift",
    f"WITH RECURSIVE {MIX_SQL}, {MIX_FOUND} SELECT institution, bd AS business_date, metric, round(z, 5) AS score FROM mx",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    f = explode_findings(decisions(spark, sf, "mix-shift-v1")).filter("code = 'MIX_SHIFT'")
    return f.select(*OCC, "metric", F.round("score", 5).alias("score"))


def shadow(spark: SparkSession, sf: str) -> DataFrame:
    from tidewatch.operators.replay import alert_codes

    out = None
    for name in ("mix-shift-v1", "mix-shift-v2"):
        d = decisions(spark, sf, name).select(
            *gov.KEY, F.lit(name).alias("challenger"), "status", alert_codes(F.col("findings")).alias("codes"), "max_severity", F.col("judged_at").alias("evaluated_at")
        )
        out = d if out is None else out.unionByName(d)
    return out


# --- incidents and quality --------------------------------------------------------------------------------

CAND = f"""{FOUND}, {S.SHIP_REFERENCE},
imp AS (SELECT f.*, a.tier, CASE WHEN f.code IN ('MISSING_DELIVERY') THEN ref.customer_count
      WHEN f.code = 'VOLUME_LOW' AND f.expected <> 0 THEN nullif(coalesce(ref.customer_count, 0.0) * greatest(0.0, 1 - coalesce(f.obs, 0.0) / f.expected), 0.0)
      WHEN f.code IN ('UNIT_SCALE_SUSPECT', 'DUPLICATE_FILE', 'NEGATIVE_AMOUNTS', 'STALE_DATA', 'LATE_DELIVERY') THEN a.customer_count END AS customers
   FROM ranked f JOIN ship_all a ON a.institution = f.institution AND a.bd = f.bd LEFT JOIN ship_ref ref ON ref.institution = f.institution AND ref.bd = f.bd
   WHERE f.r >= 2),
cand AS (SELECT institution, bd, category, any_value(tier) AS tier, string_agg(DISTINCT code, ',' ORDER BY code) AS codes, max(r) AS r,
   max(CASE WHEN customers > 0 THEN customers END) AS customers FROM imp GROUP BY institution, bd, category)"""


@query(
    "incident_candidates",
    f"WITH RECURSIVE {CAND} SELECT institution, bd AS business_date, category, codes, CASE r WHEN 3 THEN 'CRITICAL' ELSE 'WARNING' END AS severity, "
    "round(customers, 6) AS impact_customers, CASE WHEN r = 3 THEN CASE WHEN tier = 1 OR coalesce(customers, 0) >= 50000 THEN 'P1' ELSE 'P2' END "
    "ELSE CASE WHEN tier = 1 AND coalesce(customers, 0) >= 50000 THEN 'P2' ELSE 'P3' END END AS priority FROM cand",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    c = incident_candidates(decisions(spark, sf), D.institutions(spark, sf))
    return c.select(*OCC, "category", F.array_join("codes", ",").alias("codes"), "severity", r6("impact_customers"), "priority")


@query(
    "estimate_impact",
    f"WITH RECURSIVE {CAND} SELECT institution, bd AS business_date, round(max(CASE WHEN customers > 0 THEN customers END), 6) AS impact_customers, "
    "coalesce(max(CASE WHEN customers > 0 THEN 1 ELSE 0 END) = 1, false) AS has_impact FROM imp GROUP BY institution, bd",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    f = actionable_findings(explode_findings(decisions(spark, sf), "metrics", "reference"))
    i = estimate_impact(f, OCC)
    return i.select(*OCC, r6("impact_customers"), (F.col("impact_basis") != "none").alias("has_impact"))


TRUTH = """
truth AS (SELECT institution, bd, unnest(list_filter([CASE WHEN h % 97 = 0 THEN 'MISSING' END, CASE WHEN h % 89 = 0 THEN 'UNIT_SCALE' END, CASE WHEN h % 53 = 0 THEN 'STALE' END,
   CASE WHEN h % 61 = 0 THEN 'DUPLICATE_FILE' END, CASE WHEN h % 41 = 0 THEN 'LATE' END, CASE WHEN h % 1009 = 0 THEN 'LEVEL_SHIFT' END], lambda x: x IS NOT NULL)) AS kind FROM ship_exp)"""
EXPECTS = (
    "CASE kind WHEN 'MISSING' THEN 'MISSING_DELIVERY' WHEN 'UNIT_SCALE' THEN 'UNIT_SCALE_SUSPECT' WHEN 'STALE' THEN 'STALE_DATA' "
    "WHEN 'DUPLICATE_FILE' THEN 'DUPLICATE_FILE' WHEN 'LATE' THEN 'LATE_DELIVERY' END"
)
CARD = f"""{FOUND}, {TRUTH},
real AS (SELECT institution, bd, count(*) AS kinds FROM truth WHERE kind <> 'LEVEL_SHIFT' GROUP BY ALL),
alert AS (SELECT DISTINCT institution, bd FROM ranked WHERE r >= 2)"""


def scorecard(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return rm.quality_scorecard(decisions(spark, sf), D.ship_truths(expected(spark, sf), D.institutions(spark, sf)))


@query(
    "quality_scorecard",
    f"WITH RECURSIVE {CARD} SELECT t.kind, count(*) FILTER (EXISTS (SELECT 1 FROM ranked f WHERE f.institution = t.institution AND f.bd = t.bd AND f.r >= 2 "
    f"AND f.code = {EXPECTS})) AS caught, count(*) AS total FROM truth t WHERE kind <> 'LEVEL_SHIFT' GROUP BY t.kind",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return scorecard(spark, sf)[0]


@query(
    "quality_totals",
    f"WITH RECURSIVE {CARD}, x AS (SELECT count(*) AS n, count(a.bd) AS a, count(CASE WHEN a.bd IS NOT NULL THEN r.bd END) AS t FROM ship_exp e "
    "LEFT JOIN alert a ON a.institution = e.institution AND a.bd = e.bd LEFT JOIN real r ON r.institution = e.institution AND r.bd = e.bd) "
    "SELECT n AS occurrences, a AS alerts, t AS true_alerts, round(t / a, 3) AS precision, round(100 * (a - t) / n, 2) AS false_alerts_per_100 FROM x",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return scorecard(spark, sf)[1].drop("healed_still_alerting")


@query(
    "quality_false_codes",
    f"WITH RECURSIVE {CARD} SELECT code, count(*) AS n FROM (SELECT DISTINCT institution, bd, code FROM ranked WHERE r >= 2) f "
    "WHERE NOT EXISTS (SELECT 1 FROM real x WHERE x.institution = f.institution AND x.bd = f.bd) GROUP BY code",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return scorecard(spark, sf)[2]


# --- backtest -----------------------------------------------------------------------------------------------

BACK = f"""{FOUND}, bl_low AS (SELECT * REPLACE (CASE metric WHEN 'avg_amount' THEN 5.5 ELSE k END AS k) FROM bl), {volume_sql("bl_low", "vk")}, {limit_sql(400000, "lk")},
cur AS (SELECT DISTINCT institution, bd, category, code FROM ranked WHERE r >= 2 AND bd BETWEEN DATE '1999-01-01' AND DATE '1999-12-31'),
new AS (SELECT DISTINCT institution, bd, category, code FROM (SELECT institution, bd, category, code FROM ranked WHERE r >= 2 AND o < 3
   UNION ALL SELECT institution, bd, category, code FROM vk UNION ALL SELECT institution, bd, category, code FROM lk) WHERE bd BETWEEN DATE '1999-01-01' AND DATE '1999-12-31')"""
VERDICT = """
vd AS (SELECT institution, bd, ['VOLUME', 'QUALITY', 'RULE', 'TIMELINESS'][h % 4 + 1] AS category,
   ['TRUE_POSITIVE', 'FALSE_POSITIVE', 'NEW_NORMAL', 'EXPECTED_EVENT'][h % 7 % 4 + 1] AS resolution FROM ship_exp WHERE h % 3 = 0)"""


def backtest(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """A looser candidate against the contract in force, over the year 1999."""
    from datetime import date

    key = ("backtest", sf, spark.sparkContext.applicationId)
    if key not in _BACK:
        h = D.code(F.col("nk"), F.col("business_date"))
        v = (
            expected(spark, sf)
            .join(D.institutions(spark, sf).select("institution", "nk"), "institution")
            .filter(h % 3 == 0)
            .select(
                "institution",
                "slot_key",
                "business_date",
                D.pick(h, ["VOLUME", "QUALITY", "RULE", "TIMELINESS"]).alias("category"),
                D.pick(h % 7, ["TRUE_POSITIVE", "FALSE_POSITIVE", "NEW_NORMAL", "EXPECTED_EVENT"]).alias("resolution"),
            )
        )
        args = (loads(spark, sf), cal(spark, sf), labels(spark, sf), v, date(1999, 1, 1), date(1999, 12, 31), D.NOW, D.FIRST_DAY)
        loose = D.ship_contracts(spark, sf, "LOW", 400000.0)
        _BACK[key] = run_backtest(loose, D.ship_contracts(spark, sf), *args)
    return _BACK[key]


_BACK: dict = {}


@query(
    "backtest_summary",
    f"WITH RECURSIVE {BACK} SELECT code, count(*) AS n FROM new GROUP BY code UNION ALL SELECT NULL, count(DISTINCT institution || bd) FROM new",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return backtest(spark, sf)["candidate"]


@query(
    "run_backtest",
    f"WITH RECURSIVE {BACK}, {VERDICT}, x AS (SELECT v.*, EXISTS (SELECT 1 FROM new n WHERE n.institution = v.institution AND n.bd = v.bd AND n.category = v.category) AS by_new, "
    "EXISTS (SELECT 1 FROM cur n WHERE n.institution = v.institution AND n.bd = v.bd AND n.category = v.category) AS by_cur FROM vd v "
    "WHERE bd BETWEEN DATE '1999-01-01' AND DATE '1999-12-31') SELECT count(*) FILTER (resolution = 'TRUE_POSITIVE') AS true_positive_total, "
    "count(*) FILTER (resolution = 'TRUE_POSITIVE' AND by_new) AS caught_by_candidate, count(*) FILTER (resolution = 'TRUE_POSITIVE' AND by_cur) AS caught_by_current, "
    "count(*) FILTER (resolution IN ('FALSE_POSITIVE', 'NEW_NORMAL')) AS false_alarm_total, "
    "count(*) FILTER (resolution IN ('FALSE_POSITIVE', 'NEW_NORMAL') AND by_new) AS false_alarms_remaining_candidate, "
    "count(*) FILTER (resolution IN ('FALSE_POSITIVE', 'NEW_NORMAL') AND by_cur) AS false_alarms_remaining_current FROM x",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return backtest(spark, sf)["verdicts"]


@query(
    "backtest_changes",
    f"WITH RECURSIVE {BACK}, a AS (SELECT institution, bd, string_agg(code, ',' ORDER BY code) AS c FROM cur GROUP BY ALL), "
    "b AS (SELECT institution, bd, string_agg(code, ',' ORDER BY code) AS c FROM new GROUP BY ALL) "
    "SELECT coalesce(a.institution, b.institution) AS institution, coalesce(a.bd, b.bd) AS business_date, coalesce(a.c, '') AS current, coalesce(b.c, '') AS candidate "
    "FROM a FULL JOIN b ON a.institution = b.institution AND a.bd = b.bd WHERE a.c IS DISTINCT FROM b.c",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    c = backtest(spark, sf)["changes"]
    return c.select(*OCC, F.array_join("current", ",").alias("current"), F.array_join("candidate", ",").alias("candidate"))


# --- governance -----------------------------------------------------------------------------------------------


def snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    d = decisions(spark, sf)
    snap = stored(spark, sf, "ship_snapshots", lambda: gov.snapshot(d))
    return gov.evaluations(d, snap, "BACKFILL"), gov.store_snapshots(snap)


def payload_schema(spark: SparkSession, sf: str) -> str:
    return decisions(spark, sf).select(*gov.JUDGED, F.col("judged_at").alias("now")).schema.simpleString()


@query(
    "verify_decisions",
    f"WITH RECURSIVE {S.INSTITUTIONS}, {S.calendar()} SELECT count(*) AS checked, count(*) AS reproduced, 0::BIGINT AS mismatches FROM inst, cal "
    "WHERE wd IN (1, 4) AND day BETWEEN DATE '1995-01-01' AND DATE '2001-11-12'",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    evals, store = snapshots(spark, sf)
    return gov.verification_report(gov.verify_decisions(evals, store, payload_schema(spark, sf)))


@query("verify_sample", "SELECT 200::BIGINT AS checked, 200::BIGINT AS reproduced, 0::BIGINT AS mismatches")
def _(spark: SparkSession, sf: str) -> DataFrame:
    evals, store = snapshots(spark, sf)
    return gov.verification_report(gov.verify_decisions(evals, store, payload_schema(spark, sf), n=200, seed=7))


@query(
    "evaluation_dossier",
    f"WITH RECURSIVE {TIMELY} SELECT institution, bd AS business_date, status, true AS has_inputs FROM tl",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    evals, store = snapshots(spark, sf)
    d = gov.evaluation_dossier(evals, store)
    return d.select(*OCC, "status", F.col("payload").isNotNull().alias("has_inputs"))


SHADOW = f"""{FOUND}, {S.baseline(MIX).replace("bl", "mb")}, {MIX_FOUND.replace("FROM bl b", "FROM mb b")},
champ AS (SELECT e.institution, e.bd, e.h, count(f.code) > 0 AS champ FROM ship_exp e LEFT JOIN ranked f ON f.institution = e.institution AND f.bd = e.bd AND f.r >= 2 GROUP BY ALL),
chall AS (SELECT c.*, v.name AS challenger, c.champ OR EXISTS (SELECT 1 FROM mx WHERE mx.institution = c.institution AND mx.bd = c.bd
   AND (v.name = 'mix-shift-v1' OR mx.metric = 'records_per_customer')) AS chall FROM champ c, (VALUES ('mix-shift-v1'), ('mix-shift-v2')) v(name))"""


@query(
    "run_challengers",
    f"WITH RECURSIVE {SHADOW}, c AS (SELECT 'mix-shift-v1' AS challenger, institution, bd, code, r FROM ranked UNION ALL SELECT 'mix-shift-v2', institution, bd, code, r FROM ranked "
    "UNION ALL SELECT 'mix-shift-v1', institution, bd, 'MIX_SHIFT', 2 FROM mx UNION ALL SELECT 'mix-shift-v2', institution, bd, 'MIX_SHIFT', 2 FROM mx WHERE metric = 'records_per_customer') "
    "SELECT t.institution, t.bd AS business_date, v.name AS challenger, t.status, coalesce(string_agg(DISTINCT c.code, ',' ORDER BY c.code) FILTER (c.r >= 2), '') AS codes, "
    "CASE max(c.r) WHEN 3 THEN 'CRITICAL' WHEN 2 THEN 'WARNING' WHEN 1 THEN 'INFO' END AS max_severity FROM tl t CROSS JOIN (VALUES ('mix-shift-v1'), ('mix-shift-v2')) v(name) "
    "LEFT JOIN c ON c.institution = t.institution AND c.bd = t.bd AND c.challenger = v.name GROUP BY t.institution, t.bd, v.name, t.status",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return shadow(spark, sf).select(*OCC, "challenger", "status", F.array_join("codes", ",").alias("codes"), "max_severity")


@query(
    "shadow_report",
    f"WITH RECURSIVE {SHADOW}, {TRUTH}, tr AS (SELECT DISTINCT institution, bd FROM truth), s AS (SELECT c.*, t.bd IS NOT NULL AS t, c.h % 5 = 0 AS tp, c.h % 5 = 1 AS fp "
    "FROM chall c LEFT JOIN tr t ON t.institution = c.institution AND t.bd = c.bd) SELECT challenger, count(*) AS evaluated, count(*) FILTER (champ AND chall) AS agree_both, "
    "count(*) FILTER (champ AND NOT chall) AS agree_champion_only, count(*) FILTER (chall AND NOT champ) AS agree_challenger_only, count(*) FILTER (NOT champ AND NOT chall) AS agree_neither, "
    "count(*) FILTER (tp) AS confirmed_issues, count(*) FILTER (tp AND chall) AS confirmed_caught_by_challenger, count(*) FILTER (fp) AS false_alarms, "
    "count(*) FILTER (fp AND chall) AS false_alarms_challenger_still_alerts, count(*) FILTER (chall) AS challenger_alerts, count(*) FILTER (chall AND t) AS challenger_true, "
    "count(*) FILTER (champ) AS champion_alerts, count(*) FILTER (champ AND t) AS champion_true, count(*) FILTER (t) AS issues, count(*) FILTER (t AND champ) AS champion_caught, "
    "count(*) FILTER (t AND chall) AS challenger_caught FROM s GROUP BY challenger",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return gov.shadow_report(shadow_joined(spark, sf))


def shadow_joined(spark: SparkSession, sf: str) -> DataFrame:
    from tidewatch.operators.replay import alert_codes

    nations = D.institutions(spark, sf)
    h = D.code(F.col("nk"), F.col("business_date"))
    verdicts = expected(spark, sf).join(nations.select("institution", "nk"), "institution").select(
        *gov.KEY, F.when(h % 5 == 0, "TRUE_POSITIVE").when(h % 5 == 1, "FALSE_POSITIVE").alias("resolution")
    )
    champ = decisions(spark, sf).select(*gov.KEY, alert_codes(F.col("findings")).alias("codes"))
    return gov.shadow_rows(shadow(spark, sf), champ, verdicts, D.ship_truths(expected(spark, sf), nations), F.lit(D.NOW))


@query(
    "institution_series",
    f"WITH RECURSIVE {FOUND} SELECT a.bd AS business_date, t.status, round(a.avg_amount, 6) AS observed, round(b.center, 6) AS center_log, b.institution IS NULL AS learning, "
    "coalesce(a.excluded, a.h % 101 = 0) AS excluded FROM ship_all a JOIN tl t ON t.institution = a.institution AND t.bd = a.bd "
    "LEFT JOIN bl b ON b.institution = a.institution AND b.bd = a.bd AND b.metric = 'avg_amount' WHERE a.institution = 'NATION_3' AND a.bd >= DATE '2001-11-12' - 3000",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    none = decisions(spark, sf).limit(0).select(
        *gov.KEY, F.lit(0).alias("incident_id"), F.lit("").alias("incident_status"), F.lit("").alias("resolution")
    ).withColumnRenamed("incident_status", "status")
    s = rm.institution_series(decisions(spark, sf), none, "NATION_3", "avg_amount", D.END, 3000)
    return s.select(
        "business_date", "status", r6("observed"), r6(F.log1p("expected"), "center_log"), "learning", "excluded"
    )
