"""Queries over single files made of events, and over texts."""

from __future__ import annotations

from datetime import UTC, date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch import fixed
from tidewatch.functions.grounding import check_grounding, numbers_in
from tidewatch.operators import readmodels as rm
from tidewatch.operators.assign import assign_loads
from tidewatch.operators.contracts import contract_validity
from tidewatch.operators.evaluate import evaluate, explode_findings
from tidewatch.operators.inference import infer_contracts, proposed_contracts
from tidewatch.operators.metrics import build_occurrences
from tidewatch.operators.replay import SPILL
from tidewatch.operators.schedule import expand_schedule
from tidewatch.plans import domain as D
from tidewatch.plans import sqltext as S
from tidewatch.plans.registry import query, stored
from tidewatch.sources import loads as src

FROM, TO = date(2023, 12, 20), date(2024, 2, 5)
NOW = datetime(2024, 2, 5, 12, tzinfo=UTC)


def cal(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf, "calendar24", lambda: D.calendar(spark, date(2023, 11, 1), date(2024, 3, 31)))


def arr(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf, "arrivals", lambda: D.arrivals(spark, sf))


def raw(spark: SparkSession, sf: str) -> DataFrame:
    """Arrivals as a careless sender would post them."""
    a = D.arrivals(spark, sf)
    return a.withColumns(
        {
            "record_count": F.col("record_count") - 5,
            "source": F.when(F.col("record_count") % 10 == 0, "FTP").otherwise(F.col("source")),
            "content_hash": F.when(F.col("record_count") % 25 == 1, F.substring("content_hash", 1, 7)).otherwise(F.col("content_hash")),
        }
    )


RAW = f"WITH {S.ARRIVALS}, r AS (SELECT load_id, k, k - 5 < 0 AS b1, k % 10 = 0 AS b2, k % 25 = 1 AS b3 FROM arr)"


@query("read_loads", f"{RAW} SELECT load_id, k - 5 AS record_count FROM r WHERE NOT (b1 OR b2 OR b3)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return src.split_loads(raw(spark, sf))[0].select("load_id", "record_count")


@query(
    "rejected_loads",
    f"{RAW} SELECT violation, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN b1 THEN 'record_count' END, CASE WHEN b2 THEN 'source' END, CASE WHEN b3 THEN 'content_hash' END], lambda x: x IS NOT NULL)) AS violation FROM r) GROUP BY 1",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    bad = src.split_loads(raw(spark, sf))[1]
    return bad.select(F.explode("violations").alias("violation")).groupBy("violation").agg(F.count("*").alias("n"))


@query(
    "ingest_dedup",
    f"WITH {S.ARRIVALS} SELECT institution, event_type || '|' || k AS external_id, arg_min(load_id, (received_at, load_id)) AS load_id FROM arr WHERE institution <> 'S9' GROUP BY ALL",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = D.table(spark, sf, "events").select(F.col("event_id").cast("string").alias("load_id"), "event_type")
    a = D.arrivals(spark, sf).join(e, "load_id").withColumn("external_id", F.concat_ws("|", "event_type", F.col("record_count").cast("string"))).drop("event_type")
    inst = a.select("institution").distinct().filter("institution <> 'S9'")
    return src.ingest_dedup(a, inst).select("institution", "external_id", "load_id")


@query("load_facts", f"WITH {S.ARRIVALS} SELECT load_id, k AS record_count, round(value, 2) AS total_amount FROM arr WHERE institution = 'S3' AND received_at >= TIMESTAMP '2024-01-20'")
def _(spark: SparkSession, sf: str) -> DataFrame:
    f = src.load_facts(arr(spark, sf), datetime(2024, 1, 20, tzinfo=UTC), "S3")
    return f.select("load_id", "record_count", F.col("total_amount").cast("double").alias("total_amount"))


def contracts(spark: SparkSession, sf: str) -> DataFrame:
    return D.arrival_contracts(arr(spark, sf).select("institution").distinct())


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf, "arr_cand", lambda: expand_schedule(contract_validity(contracts(spark, sf)), cal(spark, sf), FROM, TO, SPILL))


def assigned(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf, "arr_assigned", lambda: assign_loads(arr(spark, sf), candidates(spark, sf), contract_validity(contracts(spark, sf))))


# The rules as a walk over each sender's files in order, on the list of deliveries around each file's day.
_UN = "[c FOR c IN {src} IF NOT list_contains(r.filled, c.slot || c.bd)]"
_TODAY = "[c FOR c IN e.win IF c.bd = e.d]"
_UNT = _UN.format(src=_TODAY)
_HINT = "[c FOR c IN e.win IF c.slot = e.slot_hint AND c.bd <= e.d]"
_HOPEN = _UN.format(src=_HINT)
_INW = f"[c FOR c IN {_UNT} IF c.ws <= e.received_at AND e.received_at <= c.dl]"
_OVER = f"[c FOR c IN {_UNT} IF c.dl < e.received_at]"
_FT = f"[c FOR c IN {_TODAY} IF list_contains(r.filled, c.slot || c.bd)]"
_AFTER = f"[c FOR c IN {_FT} IF c.dl >= e.received_at]"
_PAST = _UN.format(src="[c FOR c IN e.win IF c.bd < e.d]")
_TOM = _UN.format(src="[c FOR c IN e.win IF c.bd = e.d + 1 AND c.slot = 'weekly']")
_PICK = f"""CASE
  WHEN len({_HOPEN}) > 0 THEN {{'slot': ({_HOPEN})[-1].slot, 'bd': ({_HOPEN})[-1].bd, 'why': 'HINT'}}
  WHEN len({_HINT}) > 0 THEN {{'slot': ({_HINT})[-1].slot, 'bd': ({_HINT})[-1].bd, 'why': 'ADDITIONAL'}}
  WHEN len({_INW}) > 0 THEN {{'slot': ({_INW})[1].slot, 'bd': ({_INW})[1].bd, 'why': 'ON_TIME'}}
  WHEN len({_OVER}) > 0 THEN {{'slot': ({_OVER})[1].slot, 'bd': ({_OVER})[1].bd, 'why': 'LATE'}}
  WHEN len({_FT}) > 0 THEN {{'slot': coalesce(({_AFTER})[1].slot, ({_FT})[-1].slot), 'bd': e.d, 'why': 'ADDITIONAL'}}
  WHEN len({_UNT}) > 0 THEN {{'slot': ({_UNT})[1].slot, 'bd': e.d, 'why': 'EARLY'}}
  WHEN len({_PAST}) > 0 THEN {{'slot': ({_PAST})[-1].slot, 'bd': ({_PAST})[-1].bd, 'why': 'LATE'}}
  WHEN len({_TOM}) > 0 THEN {{'slot': ({_TOM})[1].slot, 'bd': ({_TOM})[1].bd, 'why': 'EARLY'}}
  ELSE {{'slot': '__unscheduled__', 'bd': e.d, 'why': 'UNSCHEDULED'}} END"""

WALK = f"""{S.ARRIVALS}, {S.calendar("2023-12-01", "2024-02-28")},
snd AS (SELECT DISTINCT institution, CAST(substr(institution, 2) AS INTEGER) % 2 = 1 AS odd FROM arr),
cands AS (SELECT institution, slot, day AS bd, (day + to_minutes(s)) AT TIME ZONE 'Europe/Istanbul' AT TIME ZONE 'UTC' AS ws, (day + to_minutes(d + 15)) AT TIME ZONE 'Europe/Istanbul' AT TIME ZONE 'UTC' AS dl
   FROM snd, cal, (VALUES ('morning', 360, 600), ('evening', 1020, 1200), ('weekly', 480, 720)) t(slot, s, d) WHERE CASE slot WHEN 'weekly' THEN odd AND wd = 6 ELSE is_bd END),
ev AS (SELECT *, CAST(received_at AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Istanbul' AS DATE) AS d, row_number() OVER (PARTITION BY institution ORDER BY received_at, load_id) AS i FROM arr),
wins AS (SELECT institution, x.d, list({{'dl': c.dl, 'slot': c.slot, 'bd': c.bd, 'ws': c.ws}} ORDER BY c.dl, c.slot) AS win FROM (SELECT DISTINCT institution, d FROM ev) x
   JOIN cands c USING (institution) WHERE c.bd BETWEEN x.d - 4 AND x.d + 1 GROUP BY institution, x.d),
evw AS (SELECT ev.*, coalesce(w.win, []) AS win FROM ev LEFT JOIN wins w USING (institution, d)),
walk AS (SELECT s.institution, CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS load_id, CAST(NULL AS STRUCT(slot VARCHAR, bd DATE, why VARCHAR)) AS p, CAST([] AS VARCHAR[]) AS filled FROM snd s
   UNION ALL
   SELECT institution, i, load_id, p, CASE WHEN p.why IN ('HINT', 'ON_TIME', 'LATE', 'EARLY') THEN list_append(filled, p.slot || p.bd) ELSE filled END
   FROM (SELECT e.institution, e.i, e.load_id, {_PICK} AS p, r.filled FROM walk r JOIN evw e ON e.institution = r.institution AND e.i = r.i + 1))"""


@query(
    "assign_loads_multi_slot",
    f"WITH RECURSIVE {WALK} SELECT institution, load_id, p.slot AS slot_key, p.bd AS business_date, p.why AS reason FROM walk WHERE i > 0",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return assigned(spark, sf).select("institution", "load_id", "slot_key", "business_date", "reason")


def judged(spark: SparkSession, sf: str) -> DataFrame:
    def build() -> DataFrame:
        exp = expand_schedule(contract_validity(contracts(spark, sf)), cal(spark, sf), date(2024, 1, 1), date(2024, 1, 31))
        return evaluate(build_occurrences(exp, assigned(spark, sf), candidates(spark, sf)), contracts(spark, sf), F.lit(NOW))

    return stored(spark, sf, "arr_judged", build)


@query(
    "unexpected_delivery",
    f"WITH RECURSIVE {WALK} SELECT institution, p.bd AS business_date, 'INFO' AS severity, count(*) AS files FROM walk WHERE p.why = 'UNSCHEDULED' GROUP BY ALL",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    f = explode_findings(judged(spark, sf), "load_count").filter("code = 'UNEXPECTED_DELIVERY'")
    return f.select("institution", "business_date", "severity", F.col("load_count").alias("files"))


@query(
    "evaluate_multi_slot",
    f"WITH RECURSIVE {WALK}, w AS (SELECT walk.*, a.received_at FROM walk JOIN arr a USING (load_id)), "
    "first AS (SELECT institution, p.slot AS slot, p.bd AS bd, min(received_at) AS t, count(*) AS n FROM w GROUP BY ALL) "
    "SELECT c.institution, c.slot AS slot_key, c.bd AS business_date, CASE WHEN f.t IS NULL THEN 'MISSING' WHEN f.t > c.dl THEN 'LATE' ELSE 'RECEIVED' END AS status, coalesce(f.n, 0)::BIGINT AS load_count "
    "FROM cands c LEFT JOIN first f ON f.institution = c.institution AND f.slot = c.slot AND f.bd = c.bd WHERE (c.bd BETWEEN DATE '2024-01-01' AND DATE '2024-01-31' OR f.bd IS NOT NULL) "
    "UNION ALL SELECT institution, slot, bd, 'UNSCHEDULED', n FROM first WHERE slot = '__unscheduled__'",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return judged(spark, sf).select("institution", "slot_key", "business_date", "status", "load_count")


@query(
    "backlog_health",
    f"WITH {S.ARRIVALS} SELECT count(*) AS unassigned, coalesce(epoch(TIMESTAMP '2024-02-05 12:00:00')::BIGINT - epoch(date_trunc('second', min(received_at)))::BIGINT, 0) AS oldest_age_seconds "
    "FROM arr WHERE institution IN ('S0', 'S1')",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    done = assigned(spark, sf).filter("institution not in ('S0', 'S1')")
    occ = judged(spark, sf).withColumn("evaluated_at", F.col("judged_at"))
    return rm.pipeline_health(arr(spark, sf), done, occ, NOW)[0]


@query(
    "infer_contract",
    f"""WITH {S.ARRIVALS}, {S.calendar("2023-12-01", "2024-02-28")},
u AS (SELECT 'U' || user_id AS institution, ts AS received_at FROM events),
d AS (SELECT institution, CAST(ts AS DATE) AS day, min(hour(ts) * 60 + minute(ts)) AS m FROM (SELECT institution, received_at AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Istanbul' AS ts FROM u) GROUP BY ALL),
p AS (SELECT d.institution, count(*) AS days, count(*) FILTER (c.is_bd) AS on_bd, count(*) FILTER (c.day = c.last_bd) AS on_last, quantile_cont(m, 0.03) AS q03, quantile_cont(m, 0.99) AS q99,
  [count(*) FILTER (wd = 1), count(*) FILTER (wd = 2), count(*) FILTER (wd = 3), count(*) FILTER (wd = 4), count(*) FILTER (wd = 5), count(*) FILTER (wd = 6), count(*) FILTER (wd = 7)] AS w
  FROM d JOIN cal c ON c.day = d.day WHERE d.day BETWEEN DATE '2024-01-01' AND DATE '2024-01-30' GROUP BY 1),
t AS (SELECT count(*) FILTER (is_bd) AS b, count(*) FILTER (NOT is_bd) AS o, [count(*) FILTER (wd = 1), count(*) FILTER (wd = 2), count(*) FILTER (wd = 3), count(*) FILTER (wd = 4), count(*) FILTER (wd = 5), count(*) FILTER (wd = 6), count(*) FILTER (wd = 7)] AS tw
  FROM cal WHERE day BETWEEN DATE '2024-01-01' AND DATE '2024-01-30'),
k AS (SELECT p.*, on_bd / b AS bd_cov, (days - on_bd) / o AS off_cov, [i FOR i IN [1,2,3,4,5,6,7] IF w[i] / tw[i] >= 0.7] AS wds FROM p, t),
s AS (SELECT *, coalesce(list_sum([w[i] FOR i IN wds]), 0) / days AS share FROM k),
c AS (SELECT *, CASE WHEN days < 8 THEN NULL WHEN bd_cov >= 0.85 THEN CASE WHEN off_cov >= 0.85 THEN 'EVERY_DAY' ELSE 'BUSINESS_DAYS' END
  WHEN len(wds) > 0 AND share >= 0.8 THEN 'WEEKLY' ELSE 'MONTHLY' END AS cadence FROM s)
SELECT institution, days, cadence, CASE WHEN cadence IS NOT NULL THEN greatest(0, floor(q03 / 30) * 30 - 30)::INTEGER END AS window_start_min,
  CASE WHEN cadence IS NOT NULL THEN least(1410, ceil(q99 / 30) * 30 + 60)::INTEGER END AS deadline_min FROM c""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = D.table(spark, sf, "events").select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("institution"), F.col("ts").cast("timestamp").alias("received_at"))
    i = infer_contracts(e, cal(spark, sf), fixed.DEFAULT_TIMEZONE, date(2024, 1, 1), date(2024, 1, 30))
    return i.select("institution", "days", "cadence", "window_start_min", "deadline_min")


@query("proposed_contracts")
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = D.table(spark, sf, "events").select(F.concat(F.lit("U"), (F.col("user_id") % 40).cast("string")).alias("institution"), F.col("ts").cast("timestamp").alias("received_at"))
    i = infer_contracts(e, cal(spark, sf), fixed.DEFAULT_TIMEZONE, date(2024, 1, 1), date(2024, 1, 30))
    p = proposed_contracts(i, fixed.DEFAULT_TIMEZONE)
    return p.select("institution", "status", F.col("slots.cadence")[0].alias("cadence"), F.size("metrics").alias("watches"))


# --- texts ------------------------------------------------------------------------------------------------------


@query("numbers_in")
def _(spark: SparkSession, sf: str) -> DataFrame:
    d = D.table(spark, sf, "documents").select("doc_id", numbers_in(F.col("text")).alias("n"))
    return d.select("doc_id", F.size("n").alias("numbers"), F.aggregate("n", F.lit(0.0), lambda a, x: a + F.abs(x)).alias("total"))


@query("check_grounding")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Each document against the numbers of the benchmark item its id points at."""
    docs = D.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "n_chars")
    facts = docs.select("id", F.array(F.col("n_chars").cast("double"), F.col("id").cast("double")).alias("numbers"))
    g = check_grounding(docs.select("id", "text"), facts)
    return g.select("id", "status", "checked_numbers", "unverified_total")
