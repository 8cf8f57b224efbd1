"""The incident lifecycle as a stream against the batch reconciliation, with restarts; delayed notifications."""

import random
import time
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from tidewatch.operators import incidents as I
from tidewatch.streaming import cases as C

DAY = date(2026, 9, 16)
T0 = datetime(2026, 9, 16, 6)
KEYS = "institution STRING, slot_key STRING, business_date DATE"
CAND = f"{KEYS}, category STRING, codes ARRAY<STRING>, severity STRING, priority STRING, title STRING, impact_customers DOUBLE, impact_amount DOUBLE"
SUP = "suppression_id BIGINT, institution STRING, starts_at TIMESTAMP, ends_at TIMESTAMP, reason STRING"
MSG = "kind STRING, at TIMESTAMP, " + KEYS


def run(spark, tmp_path, batches):
    """Each batch of messages is read by a new start of the stream."""
    for k, m in enumerate(batches):
        m.coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        src = spark.readStream.schema(C.MESSAGE).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        q = C.write_changelog(C.stream_reconcile(src, "EventTime"), str(tmp_path / "log"), str(tmp_path / "cp"))
        q.awaitTermination()
        assert q.exception() is None
    return C.read_changelog(spark, str(tmp_path / "log"))


def random_candidates(r):
    out = []
    for s in range(12):
        for category, codes in (("TIMELINESS", ["LATE_DELIVERY", "MISSING_DELIVERY"]), ("VOLUME", ["VOLUME_HIGH", "VOLUME_LOW"]), ("RULE", ["LIMIT_BREACH"])):
            if r.random() < 0.55:
                some = sorted(r.sample(codes, r.randint(1, len(codes))))
                out.append((f"s{s}", "daily", DAY, category, some, r.choice(["WARNING", "CRITICAL"]), r.choice(["P1", "P2", "P3"]), f"t{s}", float(s), None))
    return out


def test_stream_equals_batch(spark, tmp_path):
    """Six rounds of decisions, with verdicts and a suppression: the same events and incidents as six batch runs."""
    r = random.Random(11)
    sup = spark.createDataFrame([(7, "s3", T0 + timedelta(hours=2), T0 + timedelta(hours=3), "bakım"), (8, None, T0 + timedelta(hours=4, minutes=-1), T0 + timedelta(hours=4), "x")], SUP)
    names = spark.createDataFrame([(f"s{s}", "daily", DAY) for s in range(12)], KEYS)
    batches, want, opened, resolved, n = [], [], {}, [], 0
    for k in range(6):
        at = T0 + timedelta(hours=k)
        rows = random_candidates(r)
        cand = spark.createDataFrame(rows, CAND)
        batch = C.decision_messages(names, cand, sup, F.lit(at))
        if k in (2, 4):  # analysts decided on some of what is open
            shut = [c for j, c in enumerate(sorted(opened)) if j % 3 == 0]
            v = [(*c, "FALSE_POSITIVE", at - timedelta(minutes=5), "ada", True) for c in shut]
            closed = spark.createDataFrame(v, f"{KEYS}, category STRING, resolution STRING, resolved_at TIMESTAMP, resolved_by STRING, closed_now BOOLEAN")
            batch = batch.unionByName(C.verdict_messages(closed))
            for c in shut:
                i = opened.pop(c)
                resolved.append((*c, i[0], "RESOLVED", "FALSE_POSITIVE", at - timedelta(minutes=5)))
                want.append((c[0], c[3], "RESOLVED", tuple(i[0])))
        batches.append(batch)
        inc = spark.createDataFrame([(*c, *v) for c, v in opened.items()], f"{KEYS}, category STRING, codes ARRAY<STRING>, severity STRING, priority STRING, incident_id BIGINT, parent_id BIGINT")
        past = spark.createDataFrame(resolved, f"{KEYS}, category STRING, codes ARRAY<STRING>, status STRING, resolution STRING, resolved_at TIMESTAMP")
        changes, events = I.reconcile(inc, cand, past, sup, names, F.lit(at))
        want += [(e["institution"], e["category"], e["kind"], tuple(e["codes"])) for e in events.collect()]
        for c in changes.collect():
            case = (c["institution"], c["slot_key"], c["business_date"], c["category"])
            if c["status"] == "RESOLVED":
                opened.pop(case, None)
                resolved.append((*case, c["codes"], "RESOLVED", c["resolution"], at))
            else:
                n += 1
                opened[case] = (c["codes"], c["severity"], c["priority"], c["incident_id"] or n, None)
    log = run(spark, tmp_path, batches).cache()
    got = [(e["institution"], e["category"], e["kind"], tuple(e["codes"])) for e in log.filter("kind <> 'NOTIFY'").collect()]
    assert sorted(got) == sorted(want) and {"OPENED", "UPDATED", "AUTO_RESOLVED", "SUPPRESSED", "RESOLVED"} <= {e[2] for e in got}
    now = C.fold(log).cache()
    live = {(i["institution"], "daily", DAY, i["category"]): (i["codes"], i["severity"], i["priority"]) for i in now.filter("status = 'OPEN'").collect()}
    assert live == {k: v[:3] for k, v in opened.items()}
    assert now.filter("status = 'RESOLVED'").count() == len(resolved) and now.count() == log.filter("kind = 'OPENED'").count()
    # half of the log first, then all of it, twice
    half = C.fold(log.filter("batch_id < 3"))
    again = C.upsert_incidents(C.upsert_incidents(half, log), log)
    assert sorted(map(str, again.select("incident_id", "status", "seq").collect())) == sorted(map(str, now.select("incident_id", "status", "seq").collect()))


def msg(spark, rows):
    return C.message(spark.createDataFrame(rows, f"{MSG}, category STRING, resolution STRING, parent_id BIGINT, candidates ARRAY<{C.CANDIDATE}>"))


def one(category="TIMELINESS", priority="P1", codes=("MISSING_DELIVERY",)):
    return [(category, list(codes), "CRITICAL", priority, "t", None, None)]


def decision(name, minutes, found):
    return ("decision", T0 + timedelta(minutes=minutes), name, "daily", DAY, None, None, None, found)


def test_notifications_wait(spark, tmp_path):
    first = [decision(n, 0, one()) for n in ("stays", "heals", "linked", "decided", "drops")] + [decision("low", 0, one(priority="P3"))]
    second = [
        decision("heals", 1, []),
        ("link", T0 + timedelta(minutes=1), "linked", "daily", DAY, None, None, 99, None),
        ("verdict", T0 + timedelta(minutes=1), "decided", "daily", DAY, "TIMELINESS", "FALSE_POSITIVE", None, None),
        decision("drops", 1, one(priority="P3", codes=["LATE_DELIVERY"])),
        decision("again", 1, one()),
    ]
    third = [decision("clock", 30, [])]
    fourth = [decision("heals", 31, one()), decision("clock", 90, []), decision("stays", 31, one())]
    log = run(spark, tmp_path, [msg(spark, rows) for rows in (first, second, third, fourth, [decision("clock", 200, [])])]).cache()
    sent = sorted((r["institution"], r["status"], r["priority"]) for r in log.filter("kind = 'NOTIFY'").collect())
    assert sent == [("again", "OPEN", "P1"), ("heals", "OPEN", "P1"), ("stays", "OPEN", "P1")]
    linked = log.filter("institution = 'linked' and kind = 'LINKED'").first()
    assert (linked["parent_id"], linked["priority"], linked["status"]) == (99, "P2", "OPEN")
    assert C.fold(log).filter("institution = 'heals'").count() == 2  # opened again under a new id


def test_notification_on_wall_time(spark, tmp_path):
    """Nothing is sent in the batch that opens an incident: the delay counts from the clock, whatever the decision's time."""
    msg(spark, [decision("a", 0, one())]).coalesce(1).write.parquet(str(tmp_path / "in/0"))
    src = spark.readStream.schema(C.MESSAGE).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = C.write_changelog(C.stream_reconcile(src), str(tmp_path / "log"), str(tmp_path / "cp"), available_now=False)
    until = time.time() + 60
    while time.time() < until and not any(p["numInputRows"] for p in q.recentProgress):
        time.sleep(0.5)
    q.stop()
    assert [r["kind"] for r in C.read_changelog(spark, str(tmp_path / "log")).collect()] == ["OPENED"]
