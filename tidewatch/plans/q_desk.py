"""Queries over incidents made of orders: lists, boards, trends, reconciliation, verdicts, audit."""

from __future__ import annotations

from datetime import UTC, date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch import fixed
from tidewatch.functions.scalar import demote, priority
from tidewatch.operators import briefing, governance as gov
from tidewatch.operators import incidents as I
from tidewatch.operators import readmodels as rm
from tidewatch.operators import tuning
from tidewatch.operators.evaluate import KEY
from tidewatch.plans import domain as D
from tidewatch.plans import sqltext as S
from tidewatch.plans.registry import query, stored
from tidewatch.sources import loads as src

NOW = "TIMESTAMP '2001-08-01 12:00:00'"
OCC, INC = S.DESK_OCC, S.DESK_INC


def occ(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf, "desk_occ", lambda: D.desk_occurrences(spark, sf))


def inc(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf, "desk_inc", lambda: D.desk_incidents(spark, sf))


def now() -> Column:
    return F.lit(D.DESK_NOW)


# --- lists and boards -------------------------------------------------------------------------------------


@query(
    "list_incidents",
    f"WITH {INC} SELECT incident_id, status, priority FROM desk_inc WHERE category IN ('VOLUME', 'QUALITY') AND priority IN ('P1', 'P2') AND title ILIKE '%nation_1%' "
    "ORDER BY status = 'RESOLVED', priority, opened_at DESC, incident_id LIMIT 50 OFFSET 20",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    page, _ = rm.list_incidents(inc(spark, sf), priority=["P1", "P2"], category=["VOLUME", "QUALITY"], q="nation_1", offset=20)
    return page.select("incident_id", "status", "priority")


@query(
    "list_incidents_total",
    f"WITH {INC} SELECT count(*) AS total FROM desk_inc WHERE status IN ('OPEN', 'ACKNOWLEDGED') AND title ILIKE '%nation_1%'",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rm.list_incidents(inc(spark, sf), status=["OPEN", "ACKNOWLEDGED"], q="nation_1")[1]


AUDIT_SQL = f"""{INC},
ev AS (SELECT k AS id, 'incident' AS entity_type, nation AS entity_id, od + to_minutes(k % 1440) AS happened, 'u' || (k % 7) AS actor, 'incident.' || lower(status) AS action,
   '{{"amount":' || CAST(floor(o_totalprice) AS BIGINT) || '}}' AS details, k // 4096 AS block FROM desk_i0),
body AS (SELECT *, '{{"action":"' || action || '","actor":"' || actor || '","at":"' || strftime(happened, '%Y-%m-%dT%H:%M:%S.000000') || '","details":"' || replace(details, '"', '\\"')
   || '","entity_id":"' || entity_id || '","entity_type":"incident"}}' AS body, row_number() OVER (PARTITION BY entity_id, block ORDER BY id) AS i FROM ev),
chain AS (SELECT id, entity_id, block, i, CAST(NULL AS VARCHAR) AS prev_hash, sha256('|' || body) AS row_hash FROM body WHERE i = 1
   UNION ALL SELECT b.id, b.entity_id, b.block, b.i, c.row_hash, sha256(c.row_hash || '|' || b.body) FROM chain c JOIN body b ON b.entity_id = c.entity_id AND b.block = c.block AND b.i = c.i + 1)"""


def audit_events(spark: SparkSession, sf: str) -> DataFrame:
    o, c = D.table(spark, sf, "orders"), D.table(spark, sf, "customer")
    n = D.table(spark, sf, "nation").select("n_nationkey", "n_name")
    k = F.col("o_orderkey")
    status = D.pick(k, ["open", "resolved", "resolved", "acknowledged", "resolved"])
    return (
        o.join(c.select("c_custkey", "c_nationkey"), o.o_custkey == F.col("c_custkey"))
        .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            k.alias("id"),
            F.lit("incident").alias("entity_type"),
            F.col("n_name").alias("entity_id"),
            (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(mins=(k % 1440).cast("int"))).alias("at"),
            F.concat(F.lit("u"), (k % 7).cast("string")).alias("actor"),
            F.concat(F.lit("incident."), status).alias("action"),
            F.concat(F.lit('{"amount":'), F.floor("o_totalprice").cast("bigint").cast("string"), F.lit("}")).alias("details"),
        )
    )


def audit_log(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf, "desk_audit", lambda: gov.append_audit_chain(audit_events(spark, sf)))


@query("append_audit_chain", f"WITH RECURSIVE {AUDIT_SQL} SELECT id, entity_id, prev_hash, row_hash FROM chain")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return audit_log(spark, sf).select("id", "entity_id", "prev_hash", "row_hash")


def tampered(spark: SparkSession, sf: str) -> DataFrame:
    """Someone rewrote a few actors without rehashing."""
    return audit_log(spark, sf).withColumn("actor", F.when(F.col("id") % 1500 == 77, F.lit("x")).otherwise(F.col("actor")))


@query(
    "verify_audit_chain",
    f"WITH {AUDIT_SQL.split('chain AS')[0].rstrip().rstrip(',')}, b AS (SELECT entity_id, block, min(CASE WHEN id % 1500 = 77 THEN id END) AS bad, min(CASE WHEN id % 1500 = 77 THEN i END) AS pos, count(*) AS n FROM body GROUP BY ALL) "
    "SELECT entity_id, block, bad IS NULL AS ok, CASE WHEN bad IS NULL THEN n ELSE pos END AS rows_checked, bad AS first_broken_id FROM b",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return gov.verify_chains(tampered(spark, sf)).select("entity_id", "block", "ok", "rows_checked", "first_broken_id")


@query(
    "audit_root",
    f"WITH RECURSIVE {AUDIT_SQL}, h AS (SELECT entity_id, block, arg_max(row_hash, id) AS head FROM chain GROUP BY ALL) SELECT count(*) AS chains, "
    "sha256(concat_ws('|', sum(CAST('0x' || substr(head, 1, 15) AS BIGINT)), sum(CAST('0x' || substr(head, 17, 15) AS BIGINT)))) AS root FROM h",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return gov.audit_root(audit_log(spark, sf))


@query("list_audit", f"WITH {AUDIT_SQL.split('chain AS')[0].rstrip().rstrip(',')} SELECT id, actor, action FROM ev ORDER BY id DESC LIMIT 100")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rm.list_audit(audit_log(spark, sf), "incident").select("id", "actor", "action")


@query(
    "open_occurrences",
    f"WITH {OCC} SELECT institution, business_date, status FROM desk_occ WHERE status IN ('PENDING', 'AT_RISK') AND expected AND window_start_utc <= TIMESTAMP '2000-06-01 07:00:00'",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rm.open_occurrences(occ(spark, sf), F.lit(datetime(2000, 6, 1, 7, tzinfo=UTC))).select("institution", "business_date", "status")


@query("open_by_priority", f"WITH {INC} SELECT priority, count(*) AS n FROM desk_inc WHERE status <> 'RESOLVED' GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rm.open_by_priority(inc(spark, sf))


@query(
    "deliveries_kpi",
    f"WITH {OCC} SELECT round(count(*) FILTER (status = 'RECEIVED') / count(*), 4) AS on_time_rate, count(*) FILTER (status = 'LATE') AS late, "
    f"count(*) FILTER (status = 'MISSING') AS missing, count(*) AS deliveries FROM desk_occ WHERE expected AND deadline_utc BETWEEN {NOW} - INTERVAL 1000 DAY AND {NOW}",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rm.deliveries_kpi(occ(spark, sf), D.DESK_NOW, 1000)


@query(
    "response_times",
    f"WITH {INC}, r AS (SELECT * FROM desk_inc WHERE opened_at >= {NOW} - INTERVAL 900 DAY) SELECT (SELECT round_even(median(epoch_us(acknowledged_at) - epoch_us(opened_at)) / 60e6, 1) FROM r) "
    "AS median_minutes_to_acknowledge, (SELECT round_even(median(epoch_us(resolved_at) - epoch_us(opened_at)) / 60e6, 1) FROM r WHERE resolution IN "
    "('TRUE_POSITIVE', 'FALSE_POSITIVE', 'EXPECTED_EVENT', 'NEW_NORMAL', 'DUPLICATE')) AS median_minutes_to_resolve",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rm.response_times(inc(spark, sf), D.DESK_NOW, 900)


BOARD_DAY = date(1998, 3, 10)
BOARD = f"""{INC}, {OCC[1:]}, {S.INSTITUTIONS}, best AS (SELECT institution, business_date, min((priority, incident_id)) AS b FROM desk_inc WHERE status <> 'RESOLVED' AND business_date IS NOT NULL GROUP BY ALL),
board AS (SELECT o.institution, i.tier, o.status, o.expected, (CASE WHEN o.expected THEN 240 + 120 END)::INTEGER AS window_start, (CASE WHEN o.expected THEN 600 END)::INTEGER AS deadline,
   (hour(o.first_received_at) * 60 + minute(o.first_received_at))::INTEGER AS first_received, o.max_severity, b.b[2] AS incident_id, b.b[1] AS incident_priority
   FROM desk_occ o JOIN inst i USING (institution) LEFT JOIN best b ON b.institution = o.institution AND b.business_date = o.business_date WHERE o.business_date = DATE '1998-03-10')"""


@query(
    "today_board",
    f"WITH {BOARD} SELECT institution, tier::INTEGER AS tier, status, window_start, deadline, first_received, max_severity, incident_id, incident_priority FROM board",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    b = rm.today_board(occ(spark, sf), inc(spark, sf), D.institutions(spark, sf), BOARD_DAY, "UTC")
    return b.drop("slot_key").withColumn("tier", F.col("tier").cast("int"))


@query(
    "status_rank_board",
    f"WITH {BOARD} SELECT institution, status, list_position(['MISSING', 'AT_RISK', 'LATE', 'PENDING', 'UNSCHEDULED', 'RECEIVED'], status)::BIGINT AS rank FROM board",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    b = rm.today_board(occ(spark, sf), inc(spark, sf), D.institutions(spark, sf), BOARD_DAY, "UTC")
    return rm.status_rank_board(b).select("institution", "status", rm.status_rank(F.col("status")).alias("rank"))


@query(
    "institutions_health",
    f"WITH {INC}, {OCC[1:]}, {S.INSTITUTIONS} SELECT i.institution, i.tier::INTEGER AS tier, (SELECT round(count(*) FILTER (status = 'RECEIVED') / nullif(count(*), 0), 4) FROM desk_occ o WHERE o.institution = i.institution "
    f"AND expected AND deadline_utc BETWEEN {NOW} - INTERVAL 30 DAY AND {NOW}) AS on_time_rate_30d, (SELECT count(*) FROM desk_occ o WHERE o.institution = i.institution AND expected AND status = 'LATE' "
    f"AND deadline_utc BETWEEN {NOW} - INTERVAL 30 DAY AND {NOW}) AS late_30d, (SELECT count(*) FROM desk_inc x WHERE x.institution = i.institution AND x.status <> 'RESOLVED') AS open_incidents, "
    "(SELECT epoch(max(first_received_at))::BIGINT FROM desk_occ o WHERE o.institution = i.institution) AS last_delivery, "
    "coalesce((SELECT string_agg(status, ',') FROM desk_occ o WHERE o.institution = i.institution AND business_date = DATE '2001-08-01'), '') AS today, 1::INTEGER AS contract_version FROM inst i",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    o = occ(spark, sf)
    received = o.select("institution", F.col("first_received_at").alias("received_at"))
    contracts = D.ship_contracts(spark, sf)
    h = rm.institutions_health(o, inc(spark, sf), D.institutions(spark, sf), contracts, received, D.DESK_NOW, date(2001, 8, 1))
    return h.select(
        "institution",
        F.col("tier").cast("int").alias("tier"),
        "on_time_rate_30d",
        "late_30d",
        "open_incidents",
        F.unix_timestamp("last_delivery_at").alias("last_delivery"),
        F.array_join("today", ",").alias("today"),
        "contract_version",
    )


RES = "coalesce(resolution, CASE WHEN status <> 'RESOLVED' THEN 'OPEN' ELSE 'OTHER' END)"
COUNTS = ", ".join(f"count(*) FILTER (res = '{r}') AS {r.lower()}" for r in fixed.INSIGHT_RESOLUTIONS)
PRECISION = (
    "CASE WHEN count(*) FILTER (res IN ('TRUE_POSITIVE', 'FALSE_POSITIVE', 'NEW_NORMAL')) > 0 THEN round_even(count(*) FILTER (res = 'TRUE_POSITIVE') "
    "/ count(*) FILTER (res IN ('TRUE_POSITIVE', 'FALSE_POSITIVE', 'NEW_NORMAL')), 3) END AS precision"
)
RECENT = f"{INC}, rec AS (SELECT *, {RES} AS res FROM desk_inc WHERE opened_at >= {NOW} - INTERVAL 2000 DAY)"


@query("insights_by_code", f"WITH {RECENT} SELECT code, count(*) AS total, {COUNTS}, {PRECISION} FROM (SELECT *, unnest(codes) AS code FROM rec) GROUP BY code")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rm.insights(inc(spark, sf), D.DESK_NOW, 2000)["by_code"]


@query(
    "insights_by_institution",
    f"WITH {RECENT} SELECT coalesce(institution, 'Sistemik') AS institution, count(*) AS total, {COUNTS}, {PRECISION} FROM rec GROUP BY 1",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rm.insights(inc(spark, sf), D.DESK_NOW, 2000)["by_institution"]


@query(
    "insights_weekly",
    f"WITH {RECENT} SELECT CAST(date_trunc('week', opened_at AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Istanbul') AS DATE) AS week, count(*) AS n FROM rec GROUP BY 1",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rm.insights(inc(spark, sf), D.DESK_NOW, 2000)["weekly"]


@query(
    "insights_totals",
    f"WITH {RECENT} SELECT count(*) AS total_incidents, count(*) FILTER (resolution = 'AUTO_CLEARED') AS auto_cleared, count(*) FILTER (resolution = 'SUPPRESSED') AS suppressed FROM rec",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rm.insights(inc(spark, sf), D.DESK_NOW, 2000)["totals"]


# --- labels and truths --------------------------------------------------------------------------------------


@query(
    "learning_labels",
    f"WITH {OCC} SELECT institution, business_date, CASE WHEN regime_break THEN 'REGIME' ELSE 'EXCLUDE' END AS label FROM desk_occ WHERE excluded OR regime_break",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rm.labels_and_verdicts(occ(spark, sf), inc(spark, sf))[0].select("institution", "business_date", "label")


@query(
    "labels_and_verdicts",
    f"WITH {INC} SELECT category, resolution, count(*) AS n FROM desk_inc WHERE status = 'RESOLVED' AND institution IS NOT NULL AND resolution IN "
    "('TRUE_POSITIVE', 'FALSE_POSITIVE', 'EXPECTED_EVENT', 'NEW_NORMAL') GROUP BY ALL",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    v = rm.labels_and_verdicts(occ(spark, sf), inc(spark, sf))[1]
    return v.groupBy("category", "resolution").agg(F.count("*").alias("n"))


TRUTHS = "tr AS (SELECT institution, business_date, ['PARTIAL', 'LATE', 'NEGATIVE', 'LEVEL_SHIFT'][k % 4 + 1] AS kind FROM desk_occ WHERE k % 3 = 0)"


def truths(spark: SparkSession, sf: str) -> DataFrame:
    n = D.table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("institution"))
    o, c = D.table(spark, sf, "orders"), D.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    k = F.col("k")
    return (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("institution", F.to_date("o_orderdate").alias("business_date"))
        .agg(F.min("o_orderkey").alias("k"))
        .filter(k % 3 == 0)
        .select("institution", F.lit("daily").alias("slot_key"), "business_date", D.pick(k, ["PARTIAL", "LATE", "NEGATIVE", "LEVEL_SHIFT"]).alias("kind"))
    )


@query(
    "truth_scorecard",
    f"WITH {OCC}, {TRUTHS} SELECT t.kind, count(*) FILTER (list_contains(o.codes, CASE t.kind WHEN 'PARTIAL' THEN 'VOLUME_LOW' WHEN 'LATE' THEN 'LATE_DELIVERY' ELSE 'NEGATIVE_AMOUNTS' END)) AS caught, "
    "count(*) AS total FROM tr t JOIN desk_occ o USING (institution, business_date) WHERE t.kind <> 'LEVEL_SHIFT' AND o.evaluated_at IS NOT NULL GROUP BY 1",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rm.truth_scorecard(occ(spark, sf), truths(spark, sf))[0]


@query(
    "truth_precision",
    f"WITH {OCC}, {TRUTHS} SELECT count(*) AS alerts, round_even(count(t.kind) / count(*), 3) AS precision FROM desk_occ o LEFT JOIN tr t USING (institution, business_date) "
    "WHERE o.max_severity IN ('WARNING', 'CRITICAL') AND o.evaluated_at IS NOT NULL AND o.business_date >= (SELECT min(business_date) FROM tr)",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rm.truth_scorecard(occ(spark, sf), truths(spark, sf))[1]


@query(
    "shadow_only_challenger",
    f"WITH {OCC}, s AS (SELECT *, unnest(['a-v1', 'b-v2']) AS challenger FROM desk_occ), x AS (SELECT challenger, institution, business_date, row_number() OVER (PARTITION BY challenger "
    "ORDER BY business_date DESC, institution) AS rn FROM s WHERE len(codes) = 0 AND CASE challenger WHEN 'a-v1' THEN k % 2 = 0 ELSE k % 5 = 0 END AND evaluated_at IS NOT NULL) "
    "SELECT challenger, institution, business_date, 'MIX_SHIFT' AS codes FROM x WHERE rn <= 25",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    o = stored(spark, sf, "desk_occ_k", lambda: D.desk_occurrences(spark, sf).join(_keys(spark, sf), KEY[:1] + KEY[2:]))
    k = F.col("k")
    hit = F.array(F.lit("MIX_SHIFT"))
    none = F.array().cast("array<string>")
    shadow = o.withColumn("challenger", F.explode(F.array(F.lit("a-v1"), F.lit("b-v2")))).select(
        *KEY,
        "challenger",
        F.when(F.when(F.col("challenger") == "a-v1", k % 2 == 0).otherwise(k % 5 == 0), hit).otherwise(none).alias("codes"),
        "evaluated_at",
    )
    rows = gov.shadow_rows(shadow, o, inc(spark, sf), None, F.lit(date(1990, 1, 1)).cast("timestamp"))
    return gov.only_challenger(rows).select("challenger", "institution", "business_date", F.array_join("codes", ",").alias("codes"))


def _keys(spark: SparkSession, sf: str) -> DataFrame:
    n = D.table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("institution"))
    o, c = D.table(spark, sf, "orders"), D.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("institution", F.to_date("o_orderdate").alias("business_date")).agg(F.min("o_orderkey").alias("k"))


# --- reconciliation -------------------------------------------------------------------------------------------

# Per occurrence and category: the lowest open incident, a candidate from a key rule, resolved incidents.
RECON = f"""{INC}, {OCC[1:]},
op AS (SELECT institution, business_date, category, min(incident_id) AS id FROM desk_inc WHERE status <> 'RESOLVED' AND institution IS NOT NULL GROUP BY ALL),
opn AS (SELECT o.*, i.codes, i.severity, i.priority, i.parent_id FROM op o JOIN desk_inc i ON i.incident_id = o.id),
cnd AS (SELECT institution, business_date, ['TIMELINESS', 'VOLUME', 'QUALITY', 'RULE'][k % 4 + 1] AS category,
   CASE WHEN k % 2 = 0 THEN CASE k % 4 WHEN 0 THEN ['LATE_DELIVERY'] ELSE ['DUPLICATE_FILE', 'NEGATIVE_AMOUNTS'] END
      ELSE CASE k % 4 WHEN 1 THEN ['VOLUME_LOW'] ELSE ['LIMIT_BREACH'] END END AS codes, CASE WHEN k % 3 = 0 THEN 'CRITICAL' ELSE 'WARNING' END AS severity, 'P3' AS priority FROM desk_occ WHERE k % 6 < 5),
lst AS (SELECT institution, business_date, category, arg_max(codes, resolved_at) AS codes, arg_max(resolution, resolved_at) AS resolution FROM desk_inc WHERE status = 'RESOLVED' AND institution IS NOT NULL GROUP BY ALL),
rc AS (SELECT coalesce(o.institution, c.institution) AS institution, coalesce(o.business_date, c.business_date) AS business_date, coalesce(o.category, c.category) AS category,
   o.id AS incident_id, o.parent_id, o.codes AS oc, o.severity AS os, o.priority AS op, c.codes AS cc, c.severity AS cs, c.priority AS cp, l.codes AS lc, l.resolution AS lr
   FROM opn o FULL JOIN cnd c ON o.institution = c.institution AND o.business_date = c.business_date AND o.category = c.category
   LEFT JOIN lst l ON l.institution = coalesce(o.institution, c.institution) AND l.business_date = coalesce(o.business_date, c.business_date) AND l.category = coalesce(o.category, c.category)),
ra AS (SELECT *, CASE WHEN oc IS NOT NULL AND cc IS NOT NULL THEN CASE WHEN oc <> cc OR os <> cs THEN 'UPDATED' ELSE 'UNCHANGED' END WHEN oc IS NOT NULL THEN 'AUTO_RESOLVED'
   WHEN lc IS NOT NULL AND list_has_all(lc, cc) AND lr IS DISTINCT FROM 'AUTO_CLEARED' THEN 'ALREADY_DECIDED' WHEN institution IN ('NATION_2', 'NATION_5') THEN 'SUPPRESSED' ELSE 'OPENED' END AS action FROM rc)"""


def recon_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    i = inc(spark, sf).filter("institution is not null")
    case = [*KEY, "category"]
    rest = [c for c in i.columns if c not in case]
    opened = i.filter("status <> 'RESOLVED'").groupBy(*case).agg(F.min_by(F.struct(*rest), "incident_id").alias("r")).select(*case, "r.*")
    k = F.col("k")
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    codes = (
        F.when(k % 4 == 0, arr("LATE_DELIVERY")).when(k % 4 == 2, arr("DUPLICATE_FILE", "NEGATIVE_AMOUNTS")).when(k % 4 == 1, arr("VOLUME_LOW")).otherwise(arr("LIMIT_BREACH"))
    )
    cand = _keys(spark, sf).filter(k % 6 < 5).select(
        "institution",
        F.lit("daily").alias("slot_key"),
        "business_date",
        D.pick(k, D.DESK_CATEGORIES).alias("category"),
        codes.alias("codes"),
        F.when(k % 3 == 0, "CRITICAL").otherwise("WARNING").alias("severity"),
        F.lit("P3").alias("priority"),
    )
    return opened, cand, i


def suppressions(spark: SparkSession, sf: str) -> DataFrame:
    """Maintenance windows: one per nation, active for two of them at the desk's instant."""
    n = D.table(spark, sf, "nation")
    active = F.col("n_name").isin("NATION_2", "NATION_5")
    start = now() - F.expr("interval 1 hour")
    return n.select(
        F.col("n_nationkey").cast("bigint").alias("suppression_id"),
        F.col("n_name").alias("institution"),
        F.when(active, start).otherwise(start - F.expr("interval 9 days")).alias("starts_at"),
        F.when(active, now()).otherwise(start - F.expr("interval 8 days")).alias("ends_at"),
        F.lit("bakım").alias("reason"),
    )


def recon(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    opened, cand, i = recon_inputs(spark, sf)
    return I.reconcile(opened, cand, i, suppressions(spark, sf), occ(spark, sf).select(*KEY), now())


@query(
    "reconcile",
    f"WITH {RECON} SELECT institution, business_date, category, incident_id, action, array_to_string(CASE WHEN action IN ('UNCHANGED', 'AUTO_RESOLVED') THEN oc ELSE cc END, ',') AS codes, "
    "CASE WHEN action IN ('UNCHANGED', 'AUTO_RESOLVED') THEN op WHEN action = 'UPDATED' AND parent_id IS NOT NULL THEN 'P4' ELSE cp END AS priority, "
    "CASE WHEN action IN ('AUTO_RESOLVED', 'SUPPRESSED') THEN 'RESOLVED' ELSE 'OPEN' END AS status FROM ra WHERE action <> 'ALREADY_DECIDED'",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    c = recon(spark, sf)[0]
    return c.select("institution", "business_date", "category", "incident_id", "action", F.array_join("codes", ",").alias("codes"), "priority", "status")


@query(
    "reconcile_events",
    f"WITH {RECON}, e AS (SELECT action AS kind FROM ra WHERE action IN ('OPENED', 'UPDATED', 'AUTO_RESOLVED', 'SUPPRESSED') UNION ALL SELECT 'OPENED' FROM ra WHERE action = 'SUPPRESSED') "
    "SELECT kind, count(*) AS n FROM e GROUP BY 1",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return recon(spark, sf)[1].groupBy("kind").agg(F.count("*").alias("n"))


@query(
    "last_resolution",
    f"WITH {RECON} SELECT institution, business_date, category, array_to_string(codes, ',') AS codes, resolution FROM lst",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    r = I.last_resolution(inc(spark, sf).filter("institution is not null"))
    return r.select("institution", "business_date", "category", F.array_join("last_codes", ",").alias("codes"), F.col("last_resolution").alias("resolution"))


@query(
    "active_suppressions",
    f"WITH {INC} SELECT institution IN ('NATION_2', 'NATION_5') AS suppressed, count(*) AS n FROM desk_inc WHERE institution IS NOT NULL GROUP BY 1",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.with_suppression(inc(spark, sf).filter("institution is not null"), suppressions(spark, sf), now())
    return rows.groupBy(F.col("suppression_id").isNotNull().alias("suppressed")).agg(F.count("*").alias("n"))


VERDICTS = f"""{INC},
vd AS (SELECT incident_id, CASE incident_id % 6 WHEN 0 THEN 'TRUE_POSITIVE' WHEN 1 THEN 'FALSE_POSITIVE' WHEN 2 THEN 'NEW_NORMAL' WHEN 3 THEN 'EXPECTED_EVENT' WHEN 4 THEN 'NONSENSE' ELSE 'DUPLICATE' END AS res,
   CASE WHEN incident_id % 4 = 0 THEN ' ' ELSE 'n' END AS note FROM desk_inc WHERE incident_id % 5 < 2),
vx AS (SELECT v.*, i.status, i.kind, CASE WHEN res = 'NONSENSE' THEN 'unknown_resolution' WHEN res IN ('FALSE_POSITIVE', 'NEW_NORMAL', 'EXPECTED_EVENT') AND trim(note) = '' THEN 'note_required'
   WHEN i.status = 'RESOLVED' THEN 'already_resolved' END AS error FROM vd v JOIN desk_inc i USING (incident_id)),
af AS (SELECT i.*, CASE WHEN i.status <> 'RESOLVED' THEN coalesce(v.res, p.res) END AS now_res FROM desk_inc i LEFT JOIN vx v ON v.incident_id = i.incident_id AND v.error IS NULL
   LEFT JOIN vx p ON p.incident_id = i.parent_id AND p.error IS NULL AND p.kind = 'SYSTEMIC')"""


def verdicts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    i = inc(spark, sf)
    k = F.col("incident_id")
    v = i.filter(k % 5 < 2).select(
        "incident_id",
        F.lit("analyst").alias("actor"),
        D.pick(k, ["TRUE_POSITIVE", "FALSE_POSITIVE", "NEW_NORMAL", "EXPECTED_EVENT", "NONSENSE", "DUPLICATE"]).alias("resolution"),
        F.when(k % 4 == 0, " ").otherwise("n").alias("note"),
        now().alias("at"),
    )
    return I.apply_verdicts(i, v)


@query(
    "apply_verdicts",
    f"WITH {VERDICTS} SELECT incident_id, CASE WHEN now_res IS NOT NULL THEN 'RESOLVED' ELSE status END AS status, coalesce(now_res, resolution) AS resolution, now_res IS NOT NULL AS closed_now FROM af",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return verdicts(spark, sf)[0].select("incident_id", "status", "resolution", "closed_now")


@query(
    "verdict_labels",
    f"WITH {VERDICTS} SELECT institution, business_date, max(CASE WHEN now_res IN ('TRUE_POSITIVE', 'EXPECTED_EVENT') AND category IN ('VOLUME', 'QUALITY', 'RULE') THEN 'EXCLUDE' "
    "WHEN now_res = 'NEW_NORMAL' THEN 'REGIME' END) AS label FROM af WHERE business_date IS NOT NULL GROUP BY ALL HAVING label IS NOT NULL",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return verdicts(spark, sf)[1].select("institution", "business_date", "label")


@query("verdict_errors", f"WITH {VERDICTS} SELECT error, count(*) AS n FROM vx WHERE error IS NOT NULL GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return verdicts(spark, sf)[2].groupBy("error").agg(F.count("*").alias("n"))


# --- outages, notifications, briefs -------------------------------------------------------------------------


HIT = """hit AS (SELECT institution, business_date FROM desk_occ WHERE expected AND business_date = DATE '1998-03-06' AND (k % 3 <> 0 OR status = 'MISSING')),
due AS (SELECT count(*) AS n FROM desk_occ WHERE expected AND business_date = DATE '1998-03-06')"""


@query(
    "detect_systemic",
    f"WITH {OCC}, {HIT} SELECT any_value(due.n) AS due, count(*) AS missing FROM hit, due HAVING count(*) >= 3 AND count(*) / any_value(due.n) >= 0.5",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    o, at = outage(spark, sf)
    return I.detect_systemic(o, at).select("due", "missing")


@query(
    "scan_systemic",
    f"WITH {OCC}, t AS (SELECT DISTINCT deadline_utc AS t FROM desk_occ WHERE expected) SELECT epoch(t)::BIGINT AS at, count(*) AS due, count(*) FILTER (first_received_at IS NULL OR first_received_at > t) AS missing "
    "FROM t JOIN desk_occ o ON o.expected AND o.deadline_utc BETWEEN t - INTERVAL 90 MINUTE AND t GROUP BY t HAVING count(*) FILTER (first_received_at IS NULL OR first_received_at > t) >= 3 "
    "AND count(*) FILTER (first_received_at IS NULL OR first_received_at > t) / count(*) >= 0.5",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return I.scan_systemic(occ(spark, sf)).select(F.unix_timestamp("at").alias("at"), "due", "missing")


def outage(spark: SparkSession, sf: str) -> tuple[DataFrame, Column]:
    """The occurrences as a broad outage leaves them (two of three are missing), and the instant to look at them."""
    o = occ(spark, sf).join(_keys(spark, sf), ["institution", "business_date"])
    hit = F.when(F.col("expected") & (F.col("k") % 3 != 0), "MISSING").otherwise(F.col("status"))
    return o.withColumn("status", hit), F.lit(datetime(1998, 3, 6, 10, 45, tzinfo=UTC))


@query(
    "group_systemic",
    f"WITH {INC}, {OCC[1:]}, {HIT}, sig AS (SELECT (SELECT count(*) FROM hit) >= 3 AND (SELECT count(*) FROM hit) >= 0.5 * n AS s FROM due) "
    "SELECT i.incident_id, CASE i.priority WHEN 'P1' THEN 'P2' WHEN 'P2' THEN 'P3' ELSE 'P4' END AS priority, 'systemic:1998-03-06' AS systemic_parent "
    "FROM desk_inc i JOIN hit h USING (institution, business_date), sig WHERE s AND i.status <> 'RESOLVED' AND i.parent_id IS NULL",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    o, at = outage(spark, sf)
    _, linked = I.group_systemic(I.detect_systemic(o, at), inc(spark, sf), o, at)
    return linked.filter("linked").select("incident_id", "priority", "systemic_parent")


TR = "replace(replace(replace(format('{{:,}}', CAST({x} AS BIGINT)), ',', '#'), '.', ','), '#', '.')"


def tr(x: str) -> str:
    return TR.format(x=x).replace("{{", "{").replace("}}", "}")


MONEY_WHOLE = tr("round_even(impact_amount, 0)")


@query(
    "select_notifications",
    f"WITH {INC} SELECT incident_id, priority, '[' || priority || '] #' || incident_id || ' ' || title || CASE WHEN coalesce(impact_customers, 0) = 0 THEN '' ELSE ' — Etki: ~' || {tr('impact_customers')} || ' müşteri' "
    f"|| CASE WHEN coalesce(impact_amount, 0) = 0 THEN '' ELSE ', ~' || {MONEY_WHOLE} || ' TL borç' END END || chr(10) || 'https://desk/incidents/' || incident_id AS text "
    f"FROM desk_inc WHERE priority IN ('P1', 'P2') AND status <> 'RESOLVED' AND parent_id IS NULL AND (opened_at <= {NOW} - INTERVAL 2 MINUTE OR kind = 'SYSTEMIC')",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return I.select_notifications(inc(spark, sf), now(), "https://desk")


@query(
    "describe_impact",
    f"WITH {INC} SELECT incident_id, '~' || {tr('impact_customers')} || ' müşteri' || CASE WHEN coalesce(impact_amount, 0) = 0 THEN '' ELSE ', ~' || {MONEY_WHOLE} || ' TL borç' END AS impact "
    "FROM desk_inc WHERE coalesce(impact_customers, 0) <> 0",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    i = inc(spark, sf).select("incident_id", I.describe_impact(F.col("impact_customers"), F.col("impact_amount")).alias("impact"))
    return i.filter("impact is not null")


@query(
    "priority_for",
    f"WITH {INC}, {S.INSTITUTIONS}, p AS (SELECT i.incident_id, i.severity, coalesce(n.tier, 1) AS tier, coalesce(i.impact_customers, 0) AS c FROM desk_inc i LEFT JOIN inst n USING (institution)), "
    "q AS (SELECT incident_id, CASE WHEN severity = 'CRITICAL' THEN CASE WHEN tier = 1 OR c >= 50000 THEN 1 ELSE 2 END ELSE CASE WHEN tier = 1 AND c >= 50000 THEN 2 ELSE 3 END END AS p FROM p) "
    "SELECT incident_id, 'P' || p AS priority, 'P' || least(4, p + 1) AS demoted FROM q",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    i = inc(spark, sf).join(D.institutions(spark, sf).select("institution", "tier"), "institution", "left")
    p = priority(F.col("severity"), F.coalesce("tier", F.lit(1)), F.col("impact_customers"))
    return i.select("incident_id", p.alias("priority"), demote(p).alias("demoted"))


@query(
    "runbook_brief",
    f"WITH {INC} SELECT incident_id, title AS summary, CASE WHEN coalesce(impact_customers, 0) = 0 THEN 'Doğrudan müşteri etkisi hesaplanmadı.' ELSE 'Yaklaşık ' || {tr('impact_customers')} "
    f"|| ' müşterinin borç ödemesi etkilenebilir' || CASE WHEN coalesce(impact_amount, 0) = 0 THEN '.' ELSE ' (≈' || {MONEY_WHOLE} || ' TL).' END END AS customer_impact, "
    "list_sum(list_transform(codes, lambda c: CASE c WHEN 'MISSING_DELIVERY' THEN 3 WHEN 'VOLUME_LOW' THEN 3 WHEN 'VOLUME_HIGH' THEN 3 WHEN 'LIMIT_BREACH' THEN 1 ELSE 2 END))::INTEGER AS causes FROM desk_inc",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    f = occ(spark, sf).limit(0).select(*KEY, F.lit(0).alias("ord"), F.lit("").alias("severity"), F.lit("").alias("message"))
    b = briefing.runbook_brief(inc(spark, sf), f, briefing.runbook_table(spark))
    return b.select("incident_id", "summary", "customer_impact", F.size("likely_causes").alias("causes"))


@query(
    "recent_deliveries",
    f"WITH {INC}, {OCC[1:]}, t AS (SELECT DISTINCT institution, business_date AS target_date FROM desk_inc WHERE status = 'OPEN' AND institution IS NOT NULL), x AS (SELECT t.institution, t.target_date, o.business_date, o.status, "
    "row_number() OVER (PARTITION BY t.institution, t.target_date ORDER BY o.business_date DESC) AS rn FROM t JOIN desk_occ o ON o.institution = t.institution AND o.business_date < t.target_date AND o.business_date >= t.target_date - 30) "
    "SELECT institution, target_date, business_date, status FROM x WHERE rn <= 10",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    targets = inc(spark, sf).filter("status = 'OPEN' and institution is not null").select(*KEY).distinct()
    r = briefing.recent_deliveries(occ(spark, sf)).join(targets, KEY, "left_semi")
    r = r.select("institution", F.col("business_date").alias("target_date"), F.explode("recent").alias("r"))
    return r.select("institution", "target_date", "r.business_date", "r.status")


@query(
    "brief_facts",
    f"WITH {INC}, {OCC[1:]}, {S.INSTITUTIONS} SELECT i.incident_id, i.title, n.sector, o.status AS delivery_status, o.load_count::VARCHAR AS file_count FROM desk_inc i LEFT JOIN inst n USING (institution) "
    "LEFT JOIN desk_occ o ON o.institution = i.institution AND o.business_date = i.business_date",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    f = briefing.brief_facts(inc(spark, sf), occ(spark, sf), D.institutions(spark, sf))
    get = lambda p: F.get_json_object("facts", p)
    return f.select(
        "incident_id",
        get("$.incident.title").alias("title"),
        get("$.institution.sector").alias("sector"),
        get("$.delivery.status").alias("delivery_status"),
        get("$.delivery.file_count").alias("file_count"),
    )


# --- tuning -----------------------------------------------------------------------------------------------------

TUNE = f"""{INC}, f AS (SELECT institution, business_date, resolution, unnest(codes) AS code, incident_id AS k, impact_customers FROM desk_inc WHERE status = 'RESOLVED'
   AND resolution IN ('TRUE_POSITIVE', 'FALSE_POSITIVE', 'NEW_NORMAL') AND institution IS NOT NULL),
g AS (SELECT institution, CASE WHEN code LIKE 'VOLUME%' THEN 'VOLUME' ELSE code END AS family, CASE WHEN code LIKE 'VOLUME%' THEN 'avg_amount' ELSE 'twice' END AS sub,
   count(*) FILTER (resolution <> 'TRUE_POSITIVE') AS fa, count(*) FILTER (resolution = 'TRUE_POSITIVE') AS ok,
   quantile_disc(600 + k % 400, 0.9) FILTER (resolution <> 'TRUE_POSITIVE') AS p90 FROM f GROUP BY ALL HAVING fa >= 3 AND fa / (fa + ok) >= 0.6)"""


@query(
    "suggest_tuning",
    f"WITH {TUNE} SELECT institution, CASE family WHEN 'VOLUME' THEN 'volume:avg_amount' ELSE 'deadline:twice' END AS key, family, CASE family WHEN 'VOLUME' THEN 'LOW' "
    "ELSE CASE WHEN least(ceil((p90 + 15) / 30) * 30, 1410) <= 600 THEN '630' ELSE CAST(least(ceil((p90 + 15) / 30) * 30, 1410) AS INTEGER)::VARCHAR END END AS new_value, fa AS false_alarms, ok AS confirmed "
    "FROM g WHERE family IN ('VOLUME', 'LATE_DELIVERY', 'DELIVERY_AT_RISK')",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("incident_id")
    i = inc(spark, sf).filter("institution is not null").filter((F.col("status") == "RESOLVED") & F.col("resolution").isin("TRUE_POSITIVE", *fixed.NOISY_VERDICTS))
    code = F.col("code")
    resolved = i.withColumn("code", F.explode("codes")).select(
        "institution",
        F.lit("twice").alias("slot_key"),
        "resolution",
        "code",
        F.when(code.startswith("VOLUME"), "avg_amount").alias("metric"),
        F.lit(None).cast("double").alias("observed"),
        (600 + k % 400).cast("int").alias("arrived_min"),
    )
    s = tuning.suggest_tuning(D.ship_contracts(spark, sf), resolved)
    return s.filter("family in ('VOLUME', 'LATE_DELIVERY', 'DELIVERY_AT_RISK')").select("institution", "key", "family", "new_value", "false_alarms", "confirmed")


# --- result tables ------------------------------------------------------------------------------------------------


def decision_rows(o: DataFrame, shift: bool) -> DataFrame:
    changed = (F.dayofmonth("business_date") == 7) if shift else F.lit(False)
    return o.select(
        *KEY,
        F.when(changed, "MISSING").otherwise(F.col("status")).alias("status"),
        F.to_json("codes").alias("findings_json"),
        F.col("load_count").cast("string").alias("metrics_json"),
        F.coalesce("evaluated_at", F.lit(D.DESK_NOW)).alias("evaluated_at"),
    )


@query(
    "write_decisions",
    f"WITH {OCC} SELECT institution, business_date, 'MISSING' AS status, 'DEADLINE_SWEEP' AS trigger FROM desk_occ WHERE day(business_date) = 7 AND status <> 'MISSING'",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    o = occ(spark, sf)
    d = src.new_decisions(decision_rows(o, True), decision_rows(o, False), "DEADLINE_SWEEP")
    return d.select("institution", "business_date", "status", "trigger")


@query(
    "upsert_occurrences",
    f"WITH {OCC} SELECT institution, business_date, CASE WHEN business_date >= DATE '1998-01-01' AND business_date < DATE '1999-01-01' THEN 'LATE' ELSE status END AS status, load_count::BIGINT AS load_count FROM desk_occ",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    o = occ(spark, sf).select(*KEY, "status", "load_count")
    old = o.filter("business_date < date '1999-01-01'")
    new = o.filter("business_date >= date '1998-01-01'").withColumn("status", F.when(F.col("business_date") < F.lit(date(1999, 1, 1)), "LATE").otherwise(F.col("status")))
    return src.upsert_occurrences(old, new).select("institution", "business_date", "status", "load_count")


@query(
    "upsert_shadow",
    f"WITH {OCC} SELECT institution, business_date, CASE WHEN month(business_date) = 3 THEN 'LATE' ELSE status END AS status FROM desk_occ WHERE evaluated_at IS NOT NULL",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    o = occ(spark, sf).filter("evaluated_at is not null").select(*KEY, F.lit("a-v1").alias("challenger"), "status", "evaluated_at")
    new = o.filter(F.month("business_date") == 3).withColumns({"status": F.lit("LATE"), "evaluated_at": F.col("evaluated_at") + F.expr("interval 1 day")})
    return src.upsert_shadow(o, new).select("institution", "business_date", "status")
