"""Shared SQL fragments that state the derived tables of ``plans.domain``."""

from __future__ import annotations

FULL_HOLIDAYS = "('01-01','04-23','05-01','05-19','07-15','08-30','10-29')"


def calendar(start: str = "1994-11-01", end: str = "2002-02-28") -> str:
    return f"""
cal0 AS (SELECT CAST(d AS DATE) AS day FROM generate_series(DATE '{start}' - 60, DATE '{end}' + 60, INTERVAL 1 DAY) t(d)),
cal1 AS (SELECT day, isodow(day) AS wd, date_trunc('month', day) AS mon,
   (isodow(day) < 6 AND strftime(day, '%m-%d') NOT IN {FULL_HOLIDAYS}) AS is_bd FROM cal0),
cal2 AS (SELECT *,
   sum(is_bd::INT) OVER (ORDER BY day) AS ord,
   sum(is_bd::INT) OVER (PARTITION BY mon ORDER BY day) AS from_start,
   sum(is_bd::INT) OVER (PARTITION BY mon ORDER BY day DESC) AS from_end,
   min(CASE WHEN is_bd THEN day END) OVER (ORDER BY day ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_bd,
   max(CASE WHEN is_bd THEN day END) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_bd,
   max(CASE WHEN is_bd THEN day END) OVER (PARTITION BY mon) AS last_bd FROM cal1),
cal AS (SELECT *, CASE WHEN from_start <= 3 THEN 'START' WHEN from_end <= 3 THEN 'END' ELSE 'MID' END AS phase FROM cal2
   WHERE day BETWEEN DATE '{start}' AND DATE '{end}')"""


INSTITUTIONS = """
inst AS (SELECT n_name AS institution, n_nationkey AS nk, r_name AS sector, 1 + n_nationkey % 3 AS tier, n_nationkey % 7 <> 6 AS active
   FROM nation JOIN region ON n_regionkey = r_regionkey)"""

SHIP_RECORDS = """
ship_rec AS (SELECT n_nationkey AS nk, n_name AS institution,
   CAST(l_shipdate AS DATE) + [0,2,1,0,3,2,1][isodow(l_shipdate)] AS bd, CAST(l_orderkey % 2 AS INTEGER) AS part,
   l_orderkey, l_linenumber, o_custkey,
   CASE WHEN l_linenumber = 7 AND l_quantity <= 5 THEN CAST(0 AS DECIMAL(20,2))
        WHEN l_linenumber = 1 AND l_quantity = 1 THEN -CAST(l_extendedprice AS DECIMAL(20,2))
        ELSE CAST(l_extendedprice AS DECIMAL(20,2)) END AS amount
   FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN orders ON l_orderkey = o_orderkey),
ship_dig AS (SELECT *, md5(o_custkey || '|' || o_custkey || '|' || amount) AS dg FROM ship_rec)"""

SHIP_FILES = SHIP_RECORDS + """,
ship_files AS (SELECT nk, institution, bd, part, count(*) AS record_count, CAST(sum(amount) AS DECIMAL(20,2)) AS total_amount,
   count(DISTINCT o_custkey) AS customer_count, count(*) FILTER (amount = 0) AS zero_amount_count,
   count(*) FILTER (amount < 0) AS negative_amount_count, count(*) - count(DISTINCT o_custkey) AS duplicate_record_count,
   max(amount) AS max_amount,
   md5(concat_ws('|', count(*), sum(CAST('0x' || substr(dg, 1, 15) AS BIGINT)), sum(CAST('0x' || substr(dg, 17, 15) AS BIGINT)))) AS content_hash
   FROM ship_dig GROUP BY nk, institution, bd, part)"""

FACTS = ["record_count", "total_amount", "customer_count", "zero_amount_count", "negative_amount_count", "duplicate_record_count", "max_amount"]
_LAGS = ", ".join(
    f"CASE WHEN h % 53 = 0 THEN coalesce(lag({c}) OVER w, {c}) ELSE {c} END AS {c}" for c in FACTS
)

SHIP_LOADS = SHIP_FILES + f""",
ship_f1 AS (SELECT nk, institution, bd, part, 31 * nk + datediff('day', DATE '1995-01-01', bd) AS h, record_count,
   CAST(total_amount * CASE WHEN (31 * nk + datediff('day', DATE '1995-01-01', bd)) % 89 = 0 THEN 100 ELSE 1 END AS DECIMAL(20,2)) AS total_amount,
   customer_count, zero_amount_count, negative_amount_count, duplicate_record_count,
   CAST(max_amount * CASE WHEN (31 * nk + datediff('day', DATE '1995-01-01', bd)) % 89 = 0 THEN 100 ELSE 1 END AS DECIMAL(20,2)) AS max_amount,
   content_hash FROM ship_files),
ship_f2 AS (SELECT nk, institution, bd, part, h, (record_count * 17 + CAST(floor(abs(total_amount)) AS BIGINT)) % 90 AS seed, {_LAGS},
   CASE WHEN h % 61 = 0 AND part = 0 THEN coalesce(lag(content_hash) OVER w, content_hash) ELSE content_hash END AS content_hash
   FROM ship_f1 WINDOW w AS (PARTITION BY institution, part ORDER BY bd)),
ship_loads AS (SELECT nk || '|' || bd || '|' || part AS load_id, nk, institution, bd, part, h,
   420 + seed + 25 * part + CASE WHEN h % 41 = 0 THEN 200 WHEN h % 43 = 0 THEN -150 WHEN h % 37 = 0 THEN 75 ELSE 0 END AS minute,
   CAST(bd AS TIMESTAMP) + to_minutes(CAST(420 + seed + 25 * part + CASE WHEN h % 41 = 0 THEN 200 WHEN h % 43 = 0 THEN -150
      WHEN h % 37 = 0 THEN 75 ELSE 0 END AS INTEGER)) AS received_at,
   content_hash, {", ".join(FACTS)} FROM ship_f2 WHERE h % 97 <> 0)"""

SHIP_OCC = f"""{INSTITUTIONS}, {calendar()}, {SHIP_LOADS},
ship_exp AS (SELECT nk, institution, tier, day AS bd, 31 * nk + datediff('day', DATE '1995-01-01', day) AS h, phase, wd FROM inst, cal
   WHERE wd IN (1, 4) AND day BETWEEN DATE '1995-01-01' AND DATE '2001-11-12'),
ship_agg AS (SELECT institution, bd, sum(record_count)::DOUBLE AS record_count, sum(total_amount)::DOUBLE AS total_amount,
   sum(customer_count)::DOUBLE AS customer_count, sum(total_amount)::DOUBLE / sum(record_count)::DOUBLE AS avg_amount,
   sum(zero_amount_count)::DOUBLE / sum(record_count)::DOUBLE AS zero_amount_ratio, sum(negative_amount_count)::DOUBLE AS negative_amount_count,
   sum(duplicate_record_count)::DOUBLE / sum(record_count)::DOUBLE AS duplicate_record_ratio, count(*)::DOUBLE AS file_count,
   max(max_amount)::DOUBLE AS max_amount, min(minute) AS minute, min(received_at) AS first_received_at FROM ship_loads GROUP BY institution, bd),
ship_seen AS (SELECT institution, content_hash, min(received_at) AS seen_at FROM ship_loads GROUP BY ALL),
ship_dup AS (SELECT DISTINCT institution, bd FROM (
   SELECT l.institution, l.bd, l.content_hash, count(*) AS n, min(l.received_at) AS lo, any_value(s.seen_at) AS seen_at
   FROM ship_loads l JOIN ship_seen s ON l.institution = s.institution AND l.content_hash = s.content_hash GROUP BY 1, 2, 3)
   WHERE n > 1 OR seen_at < lo),
ship_got AS (SELECT e.nk, e.institution, e.tier, e.bd, e.h, e.phase, e.wd, a.* EXCLUDE (institution, bd), d.bd IS NOT NULL AS dup,
   CASE WHEN e.h % 101 = 0 THEN 'EXCLUDE' WHEN e.h % 1009 = 0 THEN 'REGIME' END AS label
   FROM ship_exp e JOIN ship_agg a ON e.institution = a.institution AND e.bd = a.bd
   LEFT JOIN ship_dup d ON e.institution = d.institution AND e.bd = d.bd),
ship_prev AS (SELECT *, lag(bd) OVER w AS prev_bd0, lag(record_count) OVER w AS p_rec, lag(total_amount) OVER w AS p_amt,
   lag(customer_count) OVER w AS p_cust, row_number() OVER w AS i FROM ship_got WINDOW w AS (PARTITION BY institution ORDER BY bd)),
ship_stale AS (SELECT *, CASE WHEN bd - prev_bd0 <= 400 THEN prev_bd0 END AS prev_bd,
   coalesce(NOT dup AND bd - prev_bd0 <= 400 AND record_count = p_rec AND total_amount = p_amt AND customer_count = p_cust, false) AS stale FROM ship_prev),
ship_pre AS (SELECT *, dup OR stale OR coalesce(label = 'EXCLUDE', false) AS pre FROM ship_stale)"""

_USABLE = "[x.a FOR x IN r.hist IF x.d >= s.bd - 400 AND x.a IS NOT NULL AND x.a <> 0]"
_RATIO = f"(s.avg_amount / list_median({_USABLE}))"
_NEAR = " OR ".join(f"abs({_RATIO} / {f} - 1) <= 0.35" for f in ("100.0", "0.01", "1000.0", "0.001"))
_HIT = f"coalesce(len({_USABLE}) >= 4 AND {_RATIO} > 0 AND ({_NEAR}), false)"

# A suspect is not learned from, so the days of one sender are walked in order.
SHIP_UNIT = SHIP_OCC + f""",
ship_fold AS (
   SELECT institution, i, bd, CAST(NULL AS DOUBLE) AS ref, 0 AS n, false AS suspect,
      [{{'d': bd, 'a': CASE WHEN pre THEN NULL ELSE avg_amount END}}] AS hist FROM ship_pre WHERE i = 1
   UNION ALL
   SELECT s.institution, s.i, s.bd,
      CASE WHEN len({_USABLE}) >= 4 THEN list_median({_USABLE}) END, len({_USABLE})::INTEGER, {_HIT},
      list_append(r.hist, {{'d': s.bd, 'a': CASE WHEN s.pre OR {_HIT} THEN NULL ELSE s.avg_amount END}})[-30:]
   FROM ship_fold r JOIN ship_pre s ON s.institution = r.institution AND s.i = r.i + 1),
ship_pts AS (SELECT p.*, f.ref AS unit_ref, CASE WHEN f.ref IS NULL THEN 0 ELSE f.n END AS unit_n, f.suspect, p.pre OR f.suspect AS excluded,
   coalesce(p.label = 'REGIME', false) AS regime FROM ship_pre p JOIN ship_fold f ON p.institution = f.institution AND p.bd = f.bd),
ship_all AS (SELECT e.nk, e.institution, e.tier, e.bd, e.h, e.phase, e.wd, p.* EXCLUDE (nk, institution, tier, bd, h, phase, wd) FROM ship_exp e
   LEFT JOIN ship_pts p ON e.institution = p.institution AND e.bd = p.bd)"""

SHIP_PROFILE = """
ship_arr AS (SELECT institution, bd, quantile_cont(minute, 0.5) AS median, quantile_cont(minute, 0.9) AS p90, quantile_cont(minute, 0.97) AS p97, count(*) AS n
   FROM (SELECT e.institution, e.bd, p.minute, row_number() OVER (PARTITION BY e.institution, e.bd ORDER BY p.bd DESC) AS rn
      FROM ship_exp e JOIN ship_pts p ON p.institution = e.institution AND p.bd < e.bd AND p.bd >= e.bd - 400 AND NOT p.excluded)
   WHERE rn <= 120 GROUP BY institution, bd HAVING count(*) >= 8)"""

SHIP_REFERENCE = """
ship_ref AS (SELECT institution, bd, median(record_count) AS record_count, median(total_amount) AS total_amount, median(customer_count) AS customer_count
   FROM (SELECT e.institution, e.bd, p.record_count, p.total_amount, p.customer_count,
      row_number() OVER (PARTITION BY e.institution, e.bd ORDER BY p.bd DESC) AS rn
      FROM ship_exp e JOIN ship_pts p ON p.institution = e.institution AND p.bd < e.bd AND p.bd >= e.bd - 400 AND NOT p.excluded)
   WHERE rn <= 10 GROUP BY institution, bd)"""


def _polish() -> str:
    """Three rounds of phase then weekday effects on r, groups of at least three points."""
    out, prev = [], "bl_r"
    for i in range(3):
        wd = "0.0" if i == 0 else "coalesce(we, 0.0)"
        out.append(f"""
bl_a{i} AS (SELECT *, r - {wd} AS b1 FROM {prev}),
bl_b{i} AS (SELECT *, b1 - median(b1) OVER (PARTITION BY institution, bd, metric) AS c1 FROM bl_a{i}),
bl_p{i} AS (SELECT institution, bd, metric, phase, median(c1) AS pe, count(*) AS pn FROM bl_b{i} GROUP BY ALL HAVING count(*) >= 3),
bl_c{i} AS (SELECT b.* EXCLUDE (b1, c1, pe, pn, we, wn), p.pe, p.pn, b.r - coalesce(p.pe, 0.0) AS b2 FROM bl_b{i} b
   LEFT JOIN bl_p{i} p USING (institution, bd, metric, phase)),
bl_d{i} AS (SELECT *, b2 - median(b2) OVER (PARTITION BY institution, bd, metric) AS c2 FROM bl_c{i}),
bl_w{i} AS (SELECT institution, bd, metric, wd, median(c2) AS we, count(*) AS wn FROM bl_d{i} GROUP BY ALL HAVING count(*) >= 3),
bl_e{i} AS (SELECT d.* EXCLUDE (b2, c2), w.we, w.wn FROM bl_d{i} d LEFT JOIN bl_w{i} w USING (institution, bd, metric, wd))""")
        prev = f"bl_e{i}"
    return ",".join(out)


def baseline(metrics: dict[str, tuple[str, float]]) -> str:
    """CTEs up to ``bl`` (institution, bd, metric, center, scale, ...) for metric -> (value expression, k)."""
    series = " UNION ALL ".join(
        f"SELECT institution, bd, phase, wd, regime, excluded, '{m}' AS metric, {v} AS v, {k} AS k FROM ship_pts" for m, (v, k) in metrics.items()
    )
    names = ", ".join(f"('{m}', {k})" for m, (_, k) in metrics.items())
    return f"""
bl_series AS (SELECT *, ln(1 + greatest(v, 0.0)) AS y FROM ({series}) WHERE NOT excluded AND v IS NOT NULL),
bl_target AS (SELECT e.institution, e.bd, e.phase AS tphase, e.wd AS twd, m.metric, m.k FROM ship_exp e, (VALUES {names}) m(metric, k)),
bl_clean AS (SELECT t.institution, t.bd, t.metric, p.bd AS pbd, p.bd - t.bd AS t, p.y, p.phase, p.wd, p.regime FROM bl_target t
   JOIN bl_series p ON p.institution = t.institution AND p.metric = t.metric AND p.bd < t.bd AND p.bd >= t.bd - 400),
bl_n AS (SELECT institution, bd, metric, count(*) AS n, max(t) - min(t) AS span FROM bl_clean WHERE t >= -180 GROUP BY ALL HAVING count(*) >= 8),
bl_pts AS (SELECT c.*, n.n, n.span, row_number() OVER (PARTITION BY c.institution, c.bd, c.metric ORDER BY c.t) - 1 AS i
   FROM bl_clean c JOIN bl_n n USING (institution, bd, metric) WHERE c.t >= -180),
bl_slope0 AS (SELECT a.institution, a.bd, a.metric, median((b.y - a.y) / (b.t - a.t)) AS s FROM bl_pts a
   JOIN bl_pts b ON a.institution = b.institution AND a.bd = b.bd AND a.metric = b.metric AND a.t < b.t
   WHERE a.n >= 12 AND a.span >= 45 GROUP BY ALL),
bl_slope AS (SELECT n.*, greatest(-ln(3) / 365, least(ln(3) / 365, coalesce(s.s, 0.0))) AS slope FROM bl_n n
   LEFT JOIN bl_slope0 s USING (institution, bd, metric)),
bl_r AS (SELECT p.*, s.slope, p.y - s.slope * p.t AS r, 0.0 AS pe, 0 AS pn, 0.0 AS we, 0 AS wn FROM bl_pts p JOIN bl_slope s USING (institution, bd, metric)),
{_polish()},
bl_f AS (SELECT *, r - (coalesce(pe, 0.0) + coalesce(we, 0.0)) AS flat,
   coalesce(max(CASE WHEN regime THEN i END) OVER (PARTITION BY institution, bd, metric), 0) AS start FROM bl_e2),
bl_recent AS (SELECT *, row_number() OVER (PARTITION BY institution, bd, metric ORDER BY i DESC) AS back,
   (n - start < 4 OR i >= start) AS in_level FROM bl_f),
bl_level AS (SELECT institution, bd, metric, median(flat) AS level, count(*) AS m FROM (SELECT *,
   row_number() OVER (PARTITION BY institution, bd, metric ORDER BY i DESC) AS rn FROM bl_recent WHERE in_level) WHERE rn <= 10 GROUP BY ALL),
bl_cent AS (SELECT *, flat - median(flat) OVER (PARTITION BY institution, bd, metric) AS c FROM bl_f),
bl_cent2 AS (SELECT *, abs(c - median(c) OVER (PARTITION BY institution, bd, metric)) AS ad FROM bl_cent),
bl_noise AS (SELECT institution, bd, metric, median(ad) AS mad, count(DISTINCT CASE WHEN pn IS NOT NULL THEN phase END)
   + count(DISTINCT CASE WHEN wn IS NOT NULL THEN wd END) + 1 + max(CASE WHEN slope <> 0 THEN 1 ELSE 0 END) AS params FROM bl_cent2 GROUP BY ALL),
bl_eff AS (SELECT t.institution, t.bd, t.metric, t.k, max(CASE WHEN f.phase = t.tphase THEN f.pe END) AS pe, max(CASE WHEN f.phase = t.tphase THEN f.pn END) AS pn,
   max(CASE WHEN f.wd = t.twd THEN f.we END) AS we, max(CASE WHEN f.wd = t.twd THEN f.wn END) AS wn, any_value(f.n) AS n, any_value(f.slope) AS slope,
   any_value(f.start) AS start, min(CASE WHEN r.back <= 10 THEN r.pbd END) AS rlo, max(CASE WHEN r.back <= 10 THEN r.pbd END) AS rhi
   FROM bl_target t JOIN bl_f f USING (institution, bd, metric) JOIN bl_recent r ON r.institution = f.institution AND r.bd = f.bd AND r.metric = f.metric AND r.i = f.i
   GROUP BY ALL),
bl_drift AS (SELECT e.institution, e.bd, e.metric,
   count(*) FILTER (c.pbd BETWEEN e.bd - 374 AND e.bd - 354) AS nt, count(*) FILTER (c.pbd BETWEEN e.rlo - 374 AND e.rhi - 354) AS nr,
   median(c.y) FILTER (c.pbd BETWEEN e.bd - 374 AND e.bd - 354) - median(c.y) FILTER (c.pbd BETWEEN e.rlo - 374 AND e.rhi - 354) AS drift
   FROM bl_eff e JOIN bl_clean c USING (institution, bd, metric) GROUP BY ALL),
bl_parts AS (SELECT e.*, l.level, l.m, greatest(1.4826 * x.mad * sqrt(e.n / greatest(e.n - x.params, 1)), 0.025) AS noise,
   CASE WHEN e.start = 0 AND d.nt >= 2 AND d.nr >= 2 THEN greatest(-ln(3), least(ln(3), d.drift)) ELSE 0.0 END AS annual
   FROM bl_eff e JOIN bl_level l USING (institution, bd, metric) JOIN bl_noise x USING (institution, bd, metric) LEFT JOIN bl_drift d USING (institution, bd, metric)),
bl AS (SELECT institution, bd, metric, k, n, level + annual + coalesce(pe, 0.0) + coalesce(we, 0.0) AS center,
   noise * sqrt(1 + (pi() / 2) / m + CASE WHEN pn IS NOT NULL THEN (pi() / 2) / pn ELSE 0 END + CASE WHEN wn IS NOT NULL THEN (pi() / 2) / wn ELSE 0 END) AS scale,
   exp(level) - 1 AS level, exp(slope * 30) AS trend_per_30d, exp(annual) AS annual_factor, (exp(noise) - 1) * 100 AS noise_pct FROM bl_parts)"""


SHIP_METRICS = {"avg_amount": ("avg_amount", 4.0), "total_amount": ("total_amount", 4.0)}
SHIP_BASELINE = f"{SHIP_UNIT}, {baseline(SHIP_METRICS)}"

ARRIVALS = """
arr AS (SELECT CAST(event_id AS VARCHAR) AS load_id, 'S' || (user_id % 10) AS institution, ts AS received_at,
   CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value, event_type, CASE WHEN event_type = 'signup' THEN 'evening' END AS slot_hint,
   md5(concat_ws('|', event_type, json_extract_string(props, '$.k'), CAST(floor(value) AS BIGINT))) AS content_hash FROM events)"""


def pick(key: str, values: list[str | None]) -> str:
    items = ", ".join("NULL" if v is None else f"'{v}'" for v in values)
    return f"[{items}][({key}) % {len(values)} + 1]"


_ST = pick("k", ["RECEIVED", "RECEIVED", "LATE", "RECEIVED", "MISSING", "RECEIVED", "AT_RISK", "PENDING", "RECEIVED", "UNSCHEDULED"])
DESK_OCC = f"""
desk0 AS (SELECT n_name AS institution, CAST(o_orderdate AS DATE) AS business_date, min(o_orderkey) AS k, count(*) AS c, sum(CAST(o_totalprice AS DECIMAL(20,2))) AS amount
   FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
desk_occ AS (SELECT institution, 'daily' AS slot_key, business_date, status, status <> 'UNSCHEDULED' AS expected, k,
   CASE WHEN status <> 'UNSCHEDULED' THEN business_date + INTERVAL 6 HOURS END AS window_start_utc,
   CASE WHEN status <> 'UNSCHEDULED' THEN business_date + INTERVAL 10 HOURS END AS deadline_utc,
   CASE WHEN status NOT IN ('MISSING', 'AT_RISK', 'PENDING') THEN business_date + INTERVAL 10 HOURS + to_minutes(k % 300 - 200) END AS first_received_at,
   CASE WHEN status IN ('MISSING', 'AT_RISK', 'PENDING') THEN 0 ELSE c END AS load_count, amount::DOUBLE AS total_amount,
   {pick("k", [None, "INFO", "WARNING", "CRITICAL", None])} AS max_severity,
   CASE WHEN k % 4 = 0 THEN ['VOLUME_LOW'] WHEN k % 4 = 1 THEN ['LATE_DELIVERY', 'NEGATIVE_AMOUNTS'] ELSE CAST([] AS VARCHAR[]) END AS codes,
   k % 11 = 0 AS excluded, k % 97 = 0 AS regime_break,
   CASE WHEN k % 13 <> 0 THEN business_date + INTERVAL 12 HOURS END AS evaluated_at
   FROM (SELECT *, {_ST} AS status FROM desk0))"""

_IS = pick("o_orderkey", ["OPEN", "RESOLVED", "RESOLVED", "ACKNOWLEDGED", "RESOLVED"])
_RES = pick("k", ["TRUE_POSITIVE", "FALSE_POSITIVE", "EXPECTED_EVENT", "NEW_NORMAL", "DUPLICATE", "AUTO_CLEARED", "SUPPRESSED"])
DESK_INC = f"""
desk_i0 AS (SELECT o_orderkey AS k, o_orderkey % 50 = 0 AS sys, n_name AS nation, o_orderdate AS od, o_totalprice, o_orderpriority, {_IS} AS status
   FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
desk_inc AS (SELECT k AS incident_id, CASE WHEN sys THEN 'SYSTEMIC' ELSE 'OCCURRENCE' END AS kind, CASE WHEN NOT sys THEN nation END AS institution,
   CASE WHEN NOT sys THEN 'daily' END AS slot_key, CASE WHEN NOT sys THEN CAST(od AS DATE) END AS business_date,
   CASE WHEN sys THEN 'TIMELINESS' ELSE {pick("k", ["TIMELINESS", "VOLUME", "QUALITY", "RULE"])} END AS category,
   CASE WHEN sys THEN ['SYSTEMIC_OUTAGE'] WHEN k % 4 = 0 THEN [{pick("k", ["MISSING_DELIVERY", "LATE_DELIVERY", "DELIVERY_AT_RISK"])}]
      WHEN k % 4 = 1 THEN [{pick("k", ["VOLUME_LOW", "VOLUME_HIGH"])}] WHEN k % 4 = 2 THEN ['DUPLICATE_FILE', 'NEGATIVE_AMOUNTS'] ELSE ['LIMIT_BREACH'] END AS codes,
   'Olay ' || CASE WHEN sys THEN 'Sistemik' ELSE nation END || ' ' || k AS title,
   CASE WHEN k % 3 = 0 THEN 'CRITICAL' ELSE 'WARNING' END AS severity, 'P' || least(4, CAST(substr(o_orderpriority, 1, 1) AS INTEGER)) AS priority, status,
   od + to_minutes(k % 1440) AS opened_at, CASE WHEN status <> 'OPEN' THEN od + to_minutes(k % 1440 + k % 97 + 1) END AS acknowledged_at,
   CASE WHEN status = 'RESOLVED' THEN od + to_minutes(k % 1440 + k % 2011 + 5) + to_seconds(k % 60) END AS resolved_at,
   CASE WHEN status = 'RESOLVED' THEN {_RES} END AS resolution, CASE WHEN k % 50 = 1 THEN k - 1 END AS parent_id,
   CASE WHEN k % 5 <> 0 THEN (k % 90000)::DOUBLE END AS impact_customers, CASE WHEN k % 5 > 1 THEN o_totalprice END AS impact_amount FROM desk_i0)"""
