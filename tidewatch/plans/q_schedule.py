"""Queries over calendars, schedules and contracts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch import schemas
from tidewatch.functions.scalar import local_date, local_minutes, local_to_utc
from tidewatch.operators import contracts as C
from tidewatch.operators.calendar import get_calendar, with_business_days_between, with_neighbours
from tidewatch.operators.schedule import expand_schedule
from tidewatch.plans import domain as D
from tidewatch.plans import sqltext as S
from tidewatch.plans.q_ship import cal
from tidewatch.plans.registry import query
from tidewatch.sources.holidays import build_holidays, fixed_holidays, movable_holidays
from tidewatch.sources.loads import materialize

CAL = S.calendar()


@query(
    "calendar_dim",
    f"WITH {CAL}, o AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS orders FROM orders GROUP BY 1) SELECT c.day, o.orders, c.wd::INTEGER AS iso_weekday, "
    "c.is_bd AS is_business_day, strftime(c.day, '%m-%d') = '10-28' AS is_half_day, c.phase AS month_phase, c.next_bd, c.prev_bd, c.day = c.last_bd AS is_last_bd_of_month "
    "FROM cal c JOIN o ON o.day = c.day",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    o = D.table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("orders"))
    return cal(spark, sf).join(o, "day").select(
        "day", "orders", "iso_weekday", "is_business_day", "is_half_day", "month_phase", "next_bd", "prev_bd", "is_last_bd_of_month"
    )


@query(
    "month_phase",
    f"WITH {CAL} SELECT c.phase AS month_phase, c.is_bd AS is_business_day, count(*) AS records FROM lineitem JOIN cal c ON c.day = CAST(l_shipdate AS DATE) GROUP BY ALL",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    li = D.table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.count("*").alias("n"))
    return li.join(cal(spark, sf), "day").groupBy("month_phase", "is_business_day").agg(F.sum("n").alias("records"))


@query(
    "business_days_between",
    f"WITH {CAL} SELECT o_orderpriority, sum(b.ord - a.ord)::BIGINT AS business_days, min(b.ord - a.ord)::BIGINT AS shortest, count(*) AS records "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN cal a ON a.day = CAST(o_orderdate AS DATE) JOIN cal b ON b.day = CAST(l_shipdate AS DATE) GROUP BY 1",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    o = D.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.to_date("o_orderdate").alias("ordered"))
    li = D.table(spark, sf, "lineitem").select("l_orderkey", F.to_date("l_shipdate").alias("shipped"))
    pairs = (
        li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_orderpriority", "ordered", "shipped")
        .agg(F.count("*").alias("n"))
        .withColumn("calendar", F.lit("TR"))
    )
    d = with_business_days_between(pairs, cal(spark, sf), "ordered", "shipped", "bd")
    return d.groupBy("o_orderpriority").agg(
        F.sum(F.col("bd") * F.col("n")).alias("business_days"), F.min("bd").alias("shortest"), F.sum("n").alias("records")
    )


@query(
    "next_business_day",
    f"WITH {CAL} SELECT o_orderkey, CASE WHEN c.is_bd THEN c.day ELSE c.next_bd END AS next_business_day, CASE WHEN c.is_bd THEN c.day ELSE c.prev_bd END AS previous_business_day "
    "FROM orders JOIN cal c ON c.day = CAST(o_orderdate AS DATE)",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    o = D.table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"), F.lit("TR").alias("calendar"))
    return with_neighbours(o, cal(spark, sf), "d", inclusive=True).select("o_orderkey", "next_business_day", "previous_business_day")


@query(
    "last_business_day_of_month",
    f"WITH {CAL} SELECT c.last_bd AS last_business_day, count(*) AS orders FROM orders JOIN cal c ON c.day = CAST(o_orderdate AS DATE) GROUP BY 1",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    o = D.table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    return o.join(cal(spark, sf), "day").groupBy(F.col("last_bd_of_month").alias("last_business_day")).agg(F.sum("n").alias("orders"))


MOVABLE = """
mov(first_day, days, name) AS (VALUES (DATE '2024-04-10', 3, 'Ramazan Bayramı'), (DATE '2025-03-30', 3, 'Ramazan Bayramı'), (DATE '2026-03-20', 3, 'Ramazan Bayramı'),
  (DATE '2027-03-09', 3, 'Ramazan Bayramı'), (DATE '2028-02-26', 3, 'Ramazan Bayramı'), (DATE '2024-06-16', 4, 'Kurban Bayramı'), (DATE '2025-06-06', 4, 'Kurban Bayramı'),
  (DATE '2026-05-27', 4, 'Kurban Bayramı'), (DATE '2027-05-16', 4, 'Kurban Bayramı'), (DATE '2028-05-05', 4, 'Kurban Bayramı')),
fix(m, d, name, half) AS (VALUES (1, 1, 'Yılbaşı', false), (4, 23, 'Ulusal Egemenlik ve Çocuk Bayramı', false), (5, 1, 'Emek ve Dayanışma Günü', false),
  (5, 19, 'Atatürk''ü Anma, Gençlik ve Spor Bayramı', false), (7, 15, 'Demokrasi ve Milli Birlik Günü', false), (8, 30, 'Zafer Bayramı', false),
  (10, 28, 'Cumhuriyet Bayramı arifesi', true), (10, 29, 'Cumhuriyet Bayramı', false))"""


@query(
    "build_holidays",
    f"WITH y AS (SELECT DISTINCT year(o_orderdate) + 27 AS y FROM orders), {MOVABLE}, "
    "r AS (SELECT make_date(y, m, d) AS day, 0 AS o, name, half FROM y, fix UNION ALL "
    "SELECT first_day + (i - 1)::INTEGER, 1, name || CASE WHEN i = 0 THEN ' arifesi' ELSE ' ' || i || '. gün' END, i = 0 FROM mov JOIN y ON year(first_day) = y, generate_series(0, 4) t(i) WHERE i <= days) "
    "SELECT day, string_agg(name, ' / ' ORDER BY o) AS name, bool_and(half) AS is_half_day FROM r GROUP BY day",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    years = D.table(spark, sf, "orders").select((F.year("o_orderdate") + 27).alias("year")).distinct()
    return build_holidays(fixed_holidays(spark), movable_holidays(spark), years).drop("calendar")


@query(
    "get_calendar",
    f"WITH y AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders), {MOVABLE} SELECT y AS year, count(*) FILTER (NOT half) AS full_days, count(*) FILTER (half) AS half_days FROM y, fix GROUP BY y",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    years = D.table(spark, sf, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    h = get_calendar(build_holidays(fixed_holidays(spark), movable_holidays(spark), years), "TR")
    return h.groupBy(F.year("day").cast("bigint").alias("year")).agg(F.count_if(~F.col("is_half_day")).alias("full_days"), F.count_if("is_half_day").alias("half_days"))


@query(
    "local_time",
    "SELECT event_id, CAST(ts AT TIME ZONE 'UTC' AT TIME ZONE z AS DATE) AS local_date, (hour(ts AT TIME ZONE 'UTC' AT TIME ZONE z) * 60 + minute(ts AT TIME ZONE 'UTC' AT TIME ZONE z))::INTEGER AS local_minutes, "
    "(epoch_us(ts) // 60000000 * 60)::BIGINT AS back_to_utc FROM (SELECT *, ['Europe/Istanbul', 'America/New_York', 'Asia/Kolkata'][user_id % 3 + 1] AS z FROM events)",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    tz = D.pick(F.col("user_id"), ["Europe/Istanbul", "America/New_York", "Asia/Kolkata"])
    e = D.table(spark, sf, "events").select("event_id", local_date(ts, tz).alias("local_date"), local_minutes(ts, tz).alias("local_minutes"), tz.alias("z"))
    back = F.unix_timestamp(local_to_utc(F.col("local_date"), F.col("local_minutes"), F.col("z")))
    return e.select("event_id", "local_date", "local_minutes", back.alias("back_to_utc"))


# --- schedules: one contract per supplier, cadence and shift by key -------------------------------------

SLOT_SQL = """
case s_suppkey % 6
 when 0 then named_struct('key','daily','label','d','cadence','BUSINESS_DAYS','weekdays',cast(null as array<int>),'month_days',cast(null as array<int>),'last_business_day',false,
   'holiday_shift',shift,'window_start_min',360,'deadline_min',600,'grace_minutes',cast(s_suppkey % 30 as int))
 when 1 then named_struct('key','every','label','e','cadence','EVERY_DAY','weekdays',cast(null as array<int>),'month_days',cast(null as array<int>),'last_business_day',false,
   'holiday_shift',shift,'window_start_min',0,'deadline_min',1380,'grace_minutes',0)
 when 2 then named_struct('key','weekly','label','w','cadence','WEEKLY','weekdays',array(1,4,6),'month_days',cast(null as array<int>),'last_business_day',false,
   'holiday_shift',shift,'window_start_min',480,'deadline_min',720,'grace_minutes',5)
 when 3 then named_struct('key','monthly','label','m','cadence','MONTHLY','weekdays',cast(null as array<int>),'month_days',array(1,15,31),'last_business_day',false,
   'holiday_shift',shift,'window_start_min',480,'deadline_min',720,'grace_minutes',5)
 when 4 then named_struct('key','monthly','label','m','cadence','MONTHLY','weekdays',cast(null as array<int>),'month_days',array(29,30),'last_business_day',true,
   'holiday_shift',shift,'window_start_min',480,'deadline_min',720,'grace_minutes',5)
 else named_struct('key','last','label','l','cadence','MONTHLY','weekdays',cast(null as array<int>),'month_days',cast(null as array<int>),'last_business_day',true,
   'holiday_shift',shift,'window_start_min',480,'deadline_min',720,'grace_minutes',5) end
"""


def supplier_contracts(spark: SparkSession, sf: str) -> DataFrame:
    shift = D.pick(F.floor(F.col("s_suppkey") / 6), ["NEXT_BUSINESS_DAY", "PREVIOUS_BUSINESS_DAY", "SKIP", "NONE"])
    s = D.table(spark, sf, "supplier").withColumn("shift", shift)
    return s.select(
        F.col("s_name").alias("institution"),
        F.lit(1).alias("version"),
        F.lit("APPROVED").alias("status"),
        F.lit(date(1995, 1, 1)).alias("effective_from"),
        D.pick(F.col("s_suppkey"), ["Europe/Istanbul", "Europe/Berlin", "America/New_York", "UTC", "Asia/Kolkata"]).alias("timezone"),
        F.lit("TR").alias("calendar"),
        F.array(F.expr(SLOT_SQL)).alias("slots"),
        F.expr(f"cast(array() as array<{schemas.WATCH}>)").alias("metrics"),
        F.expr(f"cast(array() as array<{schemas.LIMIT}>)").alias("limits"),
        F.expr(schemas.DEFAULT_QUALITY_SQL).alias("quality"),
        F.expr(schemas.DEFAULT_LEARNING_SQL).alias("learning"),
    )


EXPANDED = f"""{CAL},
sup AS (SELECT s_name AS institution, s_suppkey % 6 AS c, ['NEXT', 'PREVIOUS', 'SKIP', 'NONE'][s_suppkey // 6 % 4 + 1] AS sh, s_suppkey AS k,
   ['Europe/Istanbul', 'Europe/Berlin', 'America/New_York', 'UTC', 'Asia/Kolkata'][s_suppkey % 5 + 1] AS tz FROM supplier),
nom AS (SELECT sup.*, cal.*, CASE WHEN c = 3 THEN day(day) IN (1, 15) OR day(day) = least(31, day(last_day(day)))
      WHEN c = 4 THEN day(day) IN (least(29, day(last_day(day))), least(30, day(last_day(day)))) END AS by_day,
   CASE WHEN c IN (0, 1) THEN 0 WHEN is_bd THEN 0 ELSE 1 END AS moves FROM sup, cal
   WHERE day BETWEEN DATE '1995-12-22' AND DATE '1998-01-10' AND CASE c WHEN 0 THEN is_bd WHEN 1 THEN true WHEN 2 THEN wd IN (1, 4, 6)
      WHEN 3 THEN day(day) IN (1, 15) OR day(day) = least(31, day(last_day(day)))
      WHEN 4 THEN day(day) IN (least(29, day(last_day(day))), least(30, day(last_day(day)))) OR day = last_bd ELSE day = last_bd END),
moved AS (SELECT *, CASE WHEN moves = 0 OR sh = 'NONE' THEN day WHEN sh = 'NEXT' THEN next_bd WHEN sh = 'PREVIOUS' THEN prev_bd END AS bd FROM nom),
one AS (SELECT *, row_number() OVER (PARTITION BY institution, bd ORDER BY mon, coalesce(NOT by_day, true), day) AS rn FROM moved
   WHERE bd BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'),
exp AS (SELECT o.institution, CASE o.c WHEN 0 THEN 'daily' WHEN 1 THEN 'every' WHEN 2 THEN 'weekly' WHEN 5 THEN 'last' ELSE 'monthly' END AS slot_key, o.bd AS business_date, o.day AS nominal_date,
   epoch((o.bd + to_minutes(CASE o.c WHEN 0 THEN 360 WHEN 1 THEN 0 ELSE 480 END)) AT TIME ZONE o.tz)::BIGINT AS window_start,
   epoch((o.bd + to_minutes(CASE o.c WHEN 0 THEN 600 WHEN 1 THEN 1380 ELSE 720 END)) AT TIME ZONE o.tz)::BIGINT
     + 60 * CASE o.c WHEN 0 THEN o.k % 30 WHEN 1 THEN 0 ELSE 5 END AS deadline, b.phase AS month_phase FROM one o JOIN cal b ON b.day = o.bd WHERE rn = 1)"""


@query(
    "expand_schedule",
    f"WITH {EXPANDED} SELECT institution, slot_key, business_date, nominal_date, window_start, deadline, month_phase FROM exp",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = expand_schedule(supplier_contracts(spark, sf), cal(spark, sf), date(1996, 1, 1), date(1997, 12, 31))
    return e.select(
        "institution",
        "slot_key",
        "business_date",
        "nominal_date",
        F.unix_timestamp("window_start_utc").alias("window_start"),
        F.unix_timestamp("deadline_utc").alias("deadline"),
        "month_phase",
    )


@query(
    "shift_holiday",
    f"WITH {EXPANDED} SELECT slot_key, business_date > nominal_date AS moved_later, business_date < nominal_date AS moved_earlier, count(*) AS n FROM exp GROUP BY ALL",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = expand_schedule(supplier_contracts(spark, sf), cal(spark, sf), date(1996, 1, 1), date(1997, 12, 31))
    later, earlier = F.col("business_date") > F.col("nominal_date"), F.col("business_date") < F.col("nominal_date")
    return e.groupBy("slot_key", later.alias("moved_later"), earlier.alias("moved_earlier")).agg(F.count("*").alias("n"))


@query(
    "materialize",
    f"WITH {EXPANDED} SELECT institution, slot_key, business_date, 'PENDING' AS status FROM exp WHERE business_date = DATE '1997-06-02' "
    "AND institution IN (SELECT s_name FROM supplier WHERE s_suppkey % 4 <> 3 AND s_suppkey % 10 <> 0)",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    day = date(1997, 6, 2)
    e = expand_schedule(supplier_contracts(spark, sf), cal(spark, sf), day, day)
    s = D.table(spark, sf, "supplier")
    inst = s.select(F.col("s_name").alias("institution"), (F.col("s_suppkey") % 4 != 3).alias("active"))
    existing = e.join(s.filter("s_suppkey % 10 = 0").select(F.col("s_name").alias("institution")), "institution", "left_semi")
    return materialize(e, existing, inst, day).select("institution", "slot_key", "business_date", "status")


# --- contract tables ----------------------------------------------------------------------------------------


def versions(spark: SparkSession, sf: str) -> DataFrame:
    """Every supplier is one contract version of its nation."""
    s, n = D.table(spark, sf, "supplier"), D.table(spark, sf, "nation")
    k = F.col("s_suppkey")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(
        F.col("n_name").alias("institution"),
        k.cast("int").alias("version"),
        D.pick(k, ["APPROVED", "APPROVED", "PENDING", "REJECTED"]).alias("status"),
        F.date_add(F.lit(date(1995, 1, 1)), (k * 37 % 1800).cast("int")).alias("effective_from"),
        F.lit("UTC").alias("timezone"),
        F.lit("TR").alias("calendar"),
    )


VERSIONS = """
ver AS (SELECT n_name AS institution, s_suppkey::INTEGER AS version, ['APPROVED', 'APPROVED', 'PENDING', 'REJECTED'][s_suppkey % 4 + 1] AS status,
   DATE '1995-01-01' + (s_suppkey * 37 % 1800)::INTEGER AS effective_from FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


@query(
    "effective_contract",
    f"WITH {VERSIONS}, k AS (SELECT o_orderkey, n_name AS institution, CAST(o_orderdate AS DATE) AS d FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) "
    "SELECT o_orderkey, (SELECT arg_max(version, (effective_from, version)) FROM ver v WHERE v.institution = k.institution AND v.status = 'APPROVED' AND v.effective_from <= k.d) AS version FROM k",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    o, c, n = (D.table(spark, sf, t) for t in ("orders", "customer", "nation"))
    keys = (
        o.join(c.select("c_custkey", "c_nationkey"), o.o_custkey == F.col("c_custkey"))
        .join(n, F.col("c_nationkey") == n.n_nationkey)
        .select("o_orderkey", F.col("n_name").alias("institution"), F.to_date("o_orderdate").alias("on"))
    )
    return C.effective_contract(keys, versions(spark, sf)).select("o_orderkey", "version")


@query(
    "pending_approvals",
    f"WITH {VERSIONS} SELECT institution, version AS pending_version, effective_from AS pending_from, (SELECT arg_max(v.version, (v.effective_from, v.version)) FROM ver v "
    "WHERE v.institution = p.institution AND v.status = 'APPROVED' AND v.effective_from <= DATE '1998-01-01') AS current_version FROM ver p WHERE status = 'PENDING'",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return C.pending_approvals(versions(spark, sf), F.lit(date(1998, 1, 1)))


def faulty_contracts(spark: SparkSession, sf: str) -> DataFrame:
    """One contract per part, some broken by key."""
    p = D.table(spark, sf, "part")
    k = "p_partkey"
    slot = (
        f"named_struct('key', case when {k} % 5 = 0 then 'Bad Key' when {k} % 17 = 0 then '__unscheduled__' else 'main' end, 'label', p_name, "
        f"'cadence', case when {k} % 3 = 0 then 'WEEKLY' when {k} % 3 = 1 then 'MONTHLY' else 'EVERY_DAY' end, "
        f"'weekdays', case when {k} % 6 = 0 then array(1, 8) when {k} % 3 = 0 then array(2) when {k} % 12 = 2 then array(3) else cast(null as array<int>) end, "
        f"'month_days', case when {k} % 6 = 1 then array(5, 20) else cast(null as array<int>) end, 'last_business_day', {k} % 9 = 4, 'holiday_shift', 'NONE', "
        f"'window_start_min', 600, 'deadline_min', cast(500 + {k} % 200 as int), 'grace_minutes', cast({k} % 300 as int))"
    )
    limits = (
        f"array(named_struct('id', 'a', 'metric', 'record_count', 'min', case when {k} % 4 = 0 then cast(null as double) else 5.0D end, "
        f"'max', case when {k} % 4 <> 1 then cast(null as double) else cast({k} % 10 as double) end, 'severity', 'CRITICAL', 'note', ''), "
        f"named_struct('id', case when {k} % 13 = 0 then 'a' else 'b' end, 'metric', 'max_amount', 'min', 1.0D, 'max', 2.0D, 'severity', 'WARNING', 'note', ''))"
    )
    return p.select(
        F.col("p_name").alias("institution"),
        F.col(k).cast("int").alias("version"),
        F.expr(f"array({slot})").alias("slots"),
        F.expr(f"cast(array() as array<{schemas.WATCH}>)").alias("metrics"),
        F.expr(limits).alias("limits"),
        F.expr(schemas.DEFAULT_QUALITY_SQL).withField("max_zero_amount_ratio", F.expr(f"case when {k} % 11 = 0 then 1.5D else 0.05D end")).alias("quality"),
        F.expr(f"named_struct('lookback_days', cast(20 + {k} % 800 as int), 'min_history', 8)").alias("learning"),
    )


@query(
    "validate_contracts",
    """WITH p AS (SELECT p_partkey AS k, p_partkey % 3 AS c FROM part), v AS (
 SELECT k, 'slot_key_pattern' AS violation FROM p WHERE k % 5 = 0
 UNION ALL SELECT k, 'slot_key_reserved' FROM p WHERE k % 17 = 0 AND k % 5 <> 0
 UNION ALL SELECT k, 'weekdays_range' FROM p WHERE k % 6 = 0
 UNION ALL SELECT k, 'monthly_needs_days' FROM p WHERE c = 1 AND k % 6 <> 1 AND k % 9 <> 4
 UNION ALL SELECT k, 'daily_takes_no_days' FROM p WHERE c = 2 AND k % 12 = 2
 UNION ALL SELECT k, 'deadline_after_window' FROM p WHERE 500 + k % 200 <= 600
 UNION ALL SELECT k, 'grace_range' FROM p WHERE k % 300 > 240
 UNION ALL SELECT k, 'limit_needs_bound' FROM p WHERE k % 4 = 0
 UNION ALL SELECT k, 'limit_min_over_max' FROM p WHERE k % 4 = 1 AND k % 10 < 5
 UNION ALL SELECT k, 'limit_ids_unique' FROM p WHERE k % 13 = 0
 UNION ALL SELECT k, 'zero_ratio_range' FROM p WHERE k % 11 = 0
 UNION ALL SELECT k, 'lookback_range' FROM p WHERE 20 + k % 800 < 30 OR 20 + k % 800 > 730)
SELECT k::INTEGER AS version, violation FROM v""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return C.validate_contracts(faulty_contracts(spark, sf)).select("version", "violation")


def raw_specs(spark: SparkSession, sf: str) -> DataFrame:
    """Stored JSON of three format versions."""
    k = "s_suppkey"
    slots = f'[{{"key":"s', F.col(k).cast("string"), '","label":"x","cadence":"EVERY_DAY","window_start_min":60,"deadline_min":', (F.lit(600) + F.col(k) % 100).cast("string"), "}]"
    parts = F.concat(*[F.lit(x) if isinstance(x, str) else x for x in slots])
    spec = (
        F.when(F.col(k) % 4 == 0, F.concat(F.lit('{"deliveries":'), parts, F.lit(',"timezone":"UTC"}')))
        .when(F.col(k) % 4 == 1, F.concat(F.lit('{"schema_version":1,"slots":'), parts, F.lit("}")))
        .when(F.col(k) % 4 == 2, F.concat(F.lit('{"schema_version":2,"slots":'), parts, F.lit("}")))
        .otherwise(F.concat(F.lit('{"schema_version":0,"slots":'), parts, F.lit(',"deliveries":[]}')))
    )
    return D.table(spark, sf, "supplier").select(F.col("s_name").alias("institution"), F.col(k).cast("int").alias("version"), spec.alias("spec_json"))


@query(
    "upcast_contracts",
    "SELECT s_name AS institution, 1::INTEGER AS schema_version, CASE WHEN s_suppkey % 4 = 0 THEN 'UTC' ELSE 'Europe/Istanbul' END AS timezone, 's' || s_suppkey AS slot_key, "
    "(600 + s_suppkey % 100)::INTEGER AS deadline_min, 180::INTEGER AS lookback_days FROM supplier WHERE s_suppkey % 4 <> 2",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    good, _ = C.upcast_contracts(raw_specs(spark, sf))
    s = F.get("slots", F.lit(0))
    return good.select("institution", "schema_version", "timezone", s["key"].alias("slot_key"), s["deadline_min"].alias("deadline_min"), "learning.lookback_days")


@query("upcast_errors", "SELECT s_name AS institution, 'schema_version 2 is newer than 1' AS error FROM supplier WHERE s_suppkey % 4 = 2")
def _(spark: SparkSession, sf: str) -> DataFrame:
    _, errors = C.upcast_contracts(raw_specs(spark, sf))
    return errors.select("institution", "error")


def _learning(n: str) -> str:
    return f"named_struct('lookback_days', {n}, 'min_history', 8)"


def simple_contracts(spark: SparkSession, sf: str, later: bool = False) -> DataFrame:
    k = "s_suppkey"
    add = 1 if later else 0
    slot = (
        "named_struct('key', 'main', 'label', 'ana', 'cadence', 'WEEKLY', 'weekdays', array(1, 4), 'month_days', cast(null as array<int>), 'last_business_day', false, "
        f"'holiday_shift', 'SKIP', 'window_start_min', 360, 'deadline_min', cast(600 + {add} * ({k} % 3) * 30 as int), 'grace_minutes', 0)"
    )
    extra = f"{add} = 1 and {k} % 5 = 0"
    watch = "named_struct('metric', '{m}', 'sensitivity', 'LOW', 'direction', 'BOTH')"
    one, two = watch.format(m="record_count"), watch.format(m="avg_amount")
    limit = f"named_struct('id', 'cap', 'metric', 'max_amount', 'min', cast(null as double), 'max', cast({k} % 7 + 0.5D as double), 'severity', 'WARNING', 'note', 'n')"
    return D.table(spark, sf, "supplier").select(
        F.col("s_name").alias("institution"),
        F.lit(1 + add).alias("version"),
        F.lit("UTC").alias("timezone"),
        F.lit("TR").alias("calendar"),
        F.expr(f"array({slot})").alias("slots"),
        F.expr(f"case when {extra} then array({one}, {two}) else array({one}) end").alias("metrics"),
        F.expr(f"array({limit})").alias("limits"),
        F.expr(schemas.DEFAULT_QUALITY_SQL).alias("quality"),
        F.expr(_learning(f"cast(180 + {add} * ({k} % 2) * 20 as int)")).alias("learning"),
    )


@query(
    "spec_hash",
    """SELECT s_name AS institution, sha256('{"calendar":"TR","learning":{"lookback_days":180,"min_history":8},"limits":[{"id":"cap","max":' || (s_suppkey % 7)::VARCHAR
 || '.5,"metric":"max_amount","note":"n","severity":"WARNING"}],"metrics":[{"direction":"BOTH","metric":"record_count","sensitivity":"LOW"}],"quality":{"detect_duplicate_file":true,'
 || '"detect_stale_data":true,"detect_unit_scale":true,"forbid_negative_amounts":true,"max_duplicate_record_ratio":0.01,"max_zero_amount_ratio":0.05,"unexpected_delivery":"INFO"},'
 || '"slots":[{"cadence":"WEEKLY","deadline_min":600,"grace_minutes":0,"holiday_shift":"SKIP","key":"main","label":"ana","last_business_day":false,"weekdays":[1,4],"window_start_min":360}],'
 || '"timezone":"UTC"}') AS spec_hash FROM supplier""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return C.with_spec_hash(simple_contracts(spark, sf)).select("institution", "spec_hash")


@query(
    "spec_diff",
    """SELECT s_name AS institution, 'slots[main].deadline_min' AS path, '["600"]' AS before, '["' || (600 + s_suppkey % 3 * 30) || '"]' AS after FROM supplier WHERE s_suppkey % 3 <> 0
UNION ALL SELECT s_name, 'learning.lookback_days', '["180"]', '["200"]' FROM supplier WHERE s_suppkey % 2 = 1
UNION ALL SELECT s_name, 'metrics[avg_amount].' || f, NULL, '["' || v || '"]' FROM supplier, (VALUES ('direction', 'BOTH'), ('metric', 'avg_amount'), ('sensitivity', 'LOW')) t(f, v) WHERE s_suppkey % 5 = 0""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return C.spec_diff(simple_contracts(spark, sf), simple_contracts(spark, sf, later=True))
