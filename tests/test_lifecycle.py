"""Incidents, verdicts, outages, tuning, inference, audit, texts."""

from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from build import TZ, contract, contracts, slot, utc
from tidewatch.functions.grounding import check_grounding, numbers_in
from tidewatch.functions.quantiles import grouped_median
from tidewatch.operators import governance as gov
from tidewatch.operators import incidents as I
from tidewatch.operators.inference import infer_contracts, proposed_contracts
from tidewatch.operators.tuning import propose, suggest_tuning

DAY = date(2026, 9, 16)
NOW = datetime(2026, 9, 16, 12)
INC = (
    "incident_id BIGINT, kind STRING, institution STRING, slot_key STRING, business_date DATE, category STRING, codes ARRAY<STRING>, severity STRING, "
    "priority STRING, status STRING, opened_at TIMESTAMP, resolved_at TIMESTAMP, resolution STRING, parent_id BIGINT, title STRING"
)


def incident(i, name, codes, status="OPEN", category="TIMELINESS", severity="CRITICAL", priority="P1", resolution=None, parent=None, kind="OCCURRENCE"):
    done = NOW - timedelta(hours=1) if status == "RESOLVED" else None
    return (i, kind, name, "daily", DAY, category, codes, severity, priority, status, NOW - timedelta(hours=2), done, resolution, parent, f"t{i}")


CAND = "institution STRING, slot_key STRING, business_date DATE, category STRING, codes ARRAY<STRING>, severity STRING, priority STRING"
SUP = "suppression_id BIGINT, institution STRING, starts_at TIMESTAMP, ends_at TIMESTAMP, reason STRING"


def test_reconcile(spark):
    stored = [
        incident(1, "changes", ["MISSING_DELIVERY"]),
        incident(2, "clears", ["VOLUME_LOW"], category="VOLUME"),
        incident(3, "same", ["LATE_DELIVERY"], severity="WARNING"),
        incident(4, "child", ["MISSING_DELIVERY"], parent=99),
        incident(5, "decided", ["VOLUME_LOW", "VOLUME_HIGH"], "RESOLVED", "VOLUME", resolution="FALSE_POSITIVE"),
        incident(6, "healed", ["VOLUME_LOW"], "RESOLVED", "VOLUME", resolution="AUTO_CLEARED"),
    ]
    cand = [
        ("changes", "daily", DAY, "TIMELINESS", ["LATE_DELIVERY"], "WARNING", "P3"),
        ("same", "daily", DAY, "TIMELINESS", ["LATE_DELIVERY"], "WARNING", "P3"),
        ("child", "daily", DAY, "TIMELINESS", ["LATE_DELIVERY"], "WARNING", "P3"),
        ("decided", "daily", DAY, "VOLUME", ["VOLUME_LOW"], "CRITICAL", "P1"),
        ("healed", "daily", DAY, "VOLUME", ["VOLUME_LOW"], "CRITICAL", "P1"),
        ("quiet", "daily", DAY, "VOLUME", ["VOLUME_LOW"], "CRITICAL", "P1"),
    ]
    inc, c = spark.createDataFrame(stored, INC), spark.createDataFrame(cand, CAND)
    names = spark.createDataFrame([(n, "daily", DAY) for n in ("changes", "clears", "same", "child", "decided", "healed", "quiet")], "institution STRING, slot_key STRING, business_date DATE")
    sup = spark.createDataFrame([(7, "quiet", NOW - timedelta(hours=1), NOW, "bakım"), (8, None, NOW + timedelta(hours=1), NOW + timedelta(hours=2), "x")], SUP)
    changes, events = I.reconcile(inc.filter("status <> 'RESOLVED'"), c, inc, sup, names, F.lit(NOW))
    got = {r["institution"]: r for r in changes.collect()}
    assert got["changes"]["action"] == "UPDATED" and got["changes"]["codes"] == ["LATE_DELIVERY"] and got["changes"]["incident_id"] == 1
    assert got["clears"]["action"] == "AUTO_RESOLVED" and got["clears"]["resolution"] == "AUTO_CLEARED"
    assert got["same"]["action"] == "UNCHANGED" and got["same"]["priority"] == "P1"
    assert got["child"]["priority"] == "P4"
    assert "decided" not in got
    assert got["healed"]["action"] == "OPENED"
    assert (got["quiet"]["action"], got["quiet"]["status"], got["quiet"]["suppressed_by"]) == ("SUPPRESSED", "RESOLVED", 7)
    kinds = sorted(r["kind"] for r in events.filter("institution = 'quiet'").collect())
    assert kinds == ["OPENED", "SUPPRESSED"]


def test_verdicts(spark):
    inc = spark.createDataFrame(
        [
            incident(1, "a", ["VOLUME_LOW"], category="VOLUME"),
            incident(2, "b", ["LATE_DELIVERY"]),
            incident(3, "c", ["VOLUME_HIGH"], category="VOLUME"),
            incident(9, None, ["SYSTEMIC_OUTAGE"], kind="SYSTEMIC"),
            incident(10, "d", ["MISSING_DELIVERY"], parent=9),
            incident(11, "e", ["LATE_DELIVERY"], "RESOLVED", resolution="DUPLICATE"),
        ],
        INC,
    )
    v = spark.createDataFrame(
        [(1, "x", "TRUE_POSITIVE", None, NOW), (2, "x", "FALSE_POSITIVE", " ", NOW), (3, "x", "NEW_NORMAL", "n", NOW), (9, "x", "TRUE_POSITIVE", None, NOW), (11, "x", "DUPLICATE", None, NOW), (77, "x", "DUPLICATE", None, NOW)],
        "incident_id BIGINT, actor STRING, resolution STRING, note STRING, at TIMESTAMP",
    )
    after, labels, errors = I.apply_verdicts(inc, v)
    status = {r["incident_id"]: (r["status"], r["resolution"]) for r in after.collect()}
    assert status[1] == ("RESOLVED", "TRUE_POSITIVE") and status[2] == ("OPEN", None) and status[10] == ("RESOLVED", "TRUE_POSITIVE")
    assert {r["institution"]: r["label"] for r in labels.collect()} == {"a": "EXCLUDE", "c": "REGIME"}
    assert {r["incident_id"]: r["error"] for r in errors.collect()} == {2: "note_required", 11: "already_resolved", 77: "unknown_incident"}


def test_outage(spark):
    occ = spark.createDataFrame(
        [(f"i{i}", "daily", DAY, True, NOW - timedelta(minutes=30), "MISSING" if i < 3 else "RECEIVED", None if i < 3 else NOW - timedelta(hours=3)) for i in range(5)],
        "institution STRING, slot_key STRING, business_date DATE, expected BOOLEAN, deadline_utc TIMESTAMP, status STRING, first_received_at TIMESTAMP",
    )
    sig = I.detect_systemic(occ, F.lit(NOW))
    assert [(r["due"], r["missing"]) for r in sig.collect()] == [(5, 3)]
    assert [(r["due"], r["missing"]) for r in I.scan_systemic(occ).collect()] == [(5, 3)]
    inc = spark.createDataFrame([incident(i, f"i{i}", ["MISSING_DELIVERY"]) for i in range(4)] + [incident(8, "i0", ["LIMIT_BREACH"], parent=5, priority="P3")], INC)
    parent, linked = I.group_systemic(sig, inc, occ, F.lit(NOW))
    assert parent.first()["title"] == "Toplu teslimat kesintisi: 3 kurumdan dosya gelmedi (16.09.2026)"
    got = {r["incident_id"]: (r["linked"], r["priority"]) for r in linked.collect()}
    assert got == {0: (True, "P2"), 1: (True, "P2"), 2: (True, "P2"), 3: (False, "P1"), 8: (False, "P3")}
    quiet = I.detect_systemic(occ.filter("status = 'RECEIVED'"), F.lit(NOW))
    assert quiet.count() == 0


def test_tuning(spark):
    c = contracts(spark, [contract("a", metrics=[("record_count", "HIGH", "BOTH")]), contract("calm")])
    rows = [("a", "daily", "FALSE_POSITIVE", "VOLUME_HIGH", "record_count", 1.0, None)] * 4 + [("a", "daily", "TRUE_POSITIVE", "VOLUME_HIGH", "record_count", 1.0, None)]
    rows += [("a", "daily", "FALSE_POSITIVE", "LATE_DELIVERY", None, 1.0, m) for m in (610, 620, 625, 640)]
    rows += [("a", "daily", "NEW_NORMAL", "ZERO_AMOUNT_RECORDS", "zero_amount_ratio", x, None) for x in (0.06, 0.08, 0.07)]
    rows += [("calm", "daily", r, "LATE_DELIVERY", None, 1.0, 700) for r in ["FALSE_POSITIVE"] * 3 + ["TRUE_POSITIVE"] * 3]
    resolved = spark.createDataFrame(rows, "institution STRING, slot_key STRING, resolution STRING, code STRING, metric STRING, observed DOUBLE, arrived_min INT")
    s = suggest_tuning(c, resolved)
    got = {r["key"]: (r["field"], r["new_value"]) for r in s.collect()}
    assert got == {"volume:record_count": ("sensitivity", "MEDIUM"), "deadline:daily": ("deadline_min", "660"), "quality:zero_ratio": ("max_zero_amount_ratio", "0.1")}
    p = {r["key"]: r for r in propose(c, s).collect()}
    assert p["deadline:daily"]["slots"][0]["deadline_min"] == 660 and p["volume:record_count"]["metrics"][0]["sensitivity"] == "MEDIUM"
    assert p["quality:zero_ratio"]["quality"]["max_zero_amount_ratio"] == 0.1


def test_inference(spark, tr_calendar):
    start, end = date(2026, 3, 1), date(2026, 8, 31)
    days = [start + timedelta(days=i) for i in range((end - start).days + 1)]
    business = {r["day"] for r in tr_calendar.filter("is_business_day").collect()}
    rows = [("biz", utc(d, 450)) for d in days if d in business]
    rows += [("weekly", utc(d, 500)) for d in days if d.isoweekday() in (1, 4)]
    rows += [("monthly", utc(d, 700)) for d in days if d.day in (5, 20)]
    rows += [("few", utc(d, 700)) for d in days[:5]]
    a = spark.createDataFrame(rows, "institution STRING, received_at TIMESTAMP")
    inferred = infer_contracts(a, tr_calendar, TZ, start, end)
    got = {r["institution"]: r for r in inferred.collect()}
    assert got["biz"]["cadence"] == "BUSINESS_DAYS" and got["biz"]["confidence"] == 1.0
    assert (got["biz"]["window_start_min"], got["biz"]["deadline_min"]) == (420, 510)
    assert (got["weekly"]["cadence"], got["weekly"]["weekdays"]) == ("WEEKLY", [1, 4])
    assert (got["monthly"]["cadence"], got["monthly"]["month_days"]) == ("MONTHLY", [5, 20])
    assert got["few"]["cadence"] is None
    assert proposed_contracts(inferred, TZ).count() == 3


def test_audit(spark):
    e = spark.createDataFrame(
        [(i, "contract", f"c{i % 2}", NOW + timedelta(seconds=i), "u", "saved", "{}") for i in range(10)] + [(5000, "contract", "c0", NOW, "u", "saved", "{}")],
        "id BIGINT, entity_type STRING, entity_id STRING, at TIMESTAMP, actor STRING, action STRING, details STRING",
    )
    log = gov.append_audit_chain(e)
    assert all(r["ok"] for r in gov.verify_chains(log).collect())
    bad = log.withColumn("details", F.when(F.col("id") == 4, "{!}").otherwise(F.col("details")))
    got = {(r["entity_id"], r["block"]): (r["ok"], r["first_broken_id"], r["rows_checked"]) for r in gov.verify_chains(bad).collect()}
    assert got[("c0", 0)] == (False, 4, 3) and got[("c1", 0)] == (True, None, 5) and got[("c0", 1)] == (True, None, 1)


def test_global_chain(spark):
    one = spark.createDataFrame(
        [(i, "contract", "c", NOW + timedelta(seconds=i), "u", "saved", "{}") for i in range(1, 8)],
        "id BIGINT, entity_type STRING, entity_id STRING, at TIMESTAMP, actor STRING, action STRING, details STRING",
    )
    log = gov.append_audit_chain(one).drop("block")
    ok = gov.verify_audit_chain(log).first()
    assert ok["ok"] and ok["rows_checked"] == 7 and ok["head"]
    bad = gov.verify_audit_chain(log.withColumn("actor", F.when(F.col("id") == 3, "x").otherwise(F.col("actor")))).first()
    assert (bad["ok"], bad["rows_checked"], bad["first_broken_id"]) == (False, 3, 3)


def test_numbers_and_grounding(spark):
    texts = ["Kayıt 144.355 ve %0,16; 1.234.567,89 TL", "0.0016508 oranı", "150.000 müşteri", "3,14159 ve 12 gün"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t STRING").select(numbers_in(F.col("t"))).collect()]
    assert got == [[144355.0, 0.16, 1234567.89], [0.0016508], [150000.0], [3.14159, 12.0]]
    t = spark.createDataFrame([(1, "Toplam 144.355 kayıt, oran %45"), (2, "Yaklaşık 150.000 müşteri")], "id INT, text STRING")
    f = spark.createDataFrame([(1, [144000.0, 0.45]), (2, [90000.0])], "id INT, numbers ARRAY<DOUBLE>")
    r = {x["id"]: x for x in check_grounding(t, f).collect()}
    assert r[1]["status"] == "GROUNDED" and r[1]["checked_numbers"] == 2
    assert r[2]["status"] == "UNVERIFIED_NUMBERS" and r[2]["unverified"] == [150000.0]


def test_grouped_median(spark):
    import statistics

    rows = [("hot", float(i * 7919 % 1009)) for i in range(2000)] + [("even", 1.0), ("even", 4.0), ("one", 2.5), ("none", None)]
    df = spark.createDataFrame(rows, "k STRING, v DOUBLE")
    got = {r["k"]: r["median"] for r in grouped_median(df, ["k"], F.col("v"), 10.0).collect()}
    want = {k: statistics.median([v for n, v in rows if n == k]) for k in ("hot", "even", "one")}
    assert got == want
    assert slot is not None
