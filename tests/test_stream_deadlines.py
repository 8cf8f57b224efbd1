"""Timers of deliveries against the batch rule at several instants, on event time and on wall time."""

import time
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from build import TZ, utc
from tidewatch import schemas
from tidewatch.operators.detectors.timeliness import detect_timeliness
from tidewatch.streaming.deadlines import INPUT, due_rows, load_rows, statuses_at, stream_deadlines

DAY = date(2026, 9, 16)
PROFILE = "STRUCT<median: DOUBLE, p90: DOUBLE, p97: DOUBLE, n: INT>"
OCC = f"institution STRING, slot_key STRING, business_date DATE, expected BOOLEAN, timezone STRING, window_start_utc TIMESTAMP, deadline_utc TIMESTAMP, arrival {PROFILE}"
#: name, window, deadline and p97 in local minutes, and the minutes at which files came
CASES = [
    ("usual", 360, 600, 480.0, []),
    ("early", 360, 600, 300.0, []),  # at risk from the window's start
    ("unknown", 360, 600, None, []),
    ("never", 360, 600, 590.0, []),  # the deadline comes before the risk
    ("night", 1200, 1500, 1300.0, []),  # the deadline lies after midnight
    ("ontime", 360, 600, 480.0, [450, 470]),
    ("rescued", 360, 600, 480.0, [520]),
    ("late", 360, 600, 480.0, [640, 700]),
    ("edge", 360, 600, 480.4, [600]),
    ("before", 360, 600, 480.0, [300]),
    ("half", 360, 600, 480.5, []),
]


def frames(spark):
    rows = [(n, "daily", DAY, True, TZ, utc(DAY, w), utc(DAY, d), None if p is None else (p - 20, p - 5, p, 30)) for n, w, d, p, _ in CASES]
    loads = [(n, "daily", DAY, utc(DAY, m)) for n, *_, came in CASES for m in came]
    return spark.createDataFrame(rows, OCC), spark.createDataFrame(loads, "institution STRING, slot_key STRING, business_date DATE, received_at TIMESTAMP")


def batch(occ, loads, now):
    """Statuses by the batch rule with the files that came by ``now``."""
    got = loads.filter(F.col("received_at") <= F.lit(now)).groupBy("institution", "slot_key", "business_date").agg(F.min("received_at").alias("first_received_at"), F.count("*").alias("load_count"))
    rows = occ.join(got, ["institution", "slot_key", "business_date"], "left").withColumns({"load_count": F.coalesce("load_count", F.lit(0)), "quality": F.expr(schemas.DEFAULT_QUALITY_SQL)})
    return {r["institution"]: r["status"] for r in detect_timeliness(rows, F.lit(now)).select("institution", "status").collect()}


def test_statuses_at_instants(spark, tmp_path):
    occ, loads = frames(spark)
    clock = spark.createDataFrame([("~", "", DAY, "clock", utc(DAY, m), None, None, None) for m in range(290, 1620, 30)], INPUT)
    rows = sorted(due_rows(occ).unionByName(load_rows(loads)).unionByName(clock).collect(), key=lambda r: (r["at"], r["kind"]))
    opened = [r for r in rows if r["kind"] == "due"]
    rest = [r for r in rows if r["kind"] != "due"]
    steps = [opened[:6], opened[6:], *(rest[k : k + 6] for k in range(0, len(rest), 6))]
    # A third of the input, then the rest after a restart.
    for part in (range(3), range(3, len(steps))):
        for k in part:
            spark.createDataFrame([tuple(r) for r in steps[k]], INPUT).coalesce(1).write.parquet(str(tmp_path / f"in/{k:03d}"))
        q = stream_deadlines(spark.readStream.schema(INPUT).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 4).parquet(str(tmp_path / "in")), "EventTime", "20 hours")
        q = q.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None
    # a last row a day later lets all timers fire
    spark.createDataFrame([("~", "", DAY, "clock", utc(DAY + timedelta(days=2), 0), None, None, None)], INPUT).write.parquet(str(tmp_path / "in/end"))
    q = stream_deadlines(spark.readStream.schema(INPUT).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")), "EventTime", "20 hours")
    q.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).cache()
    seen = set()
    for m in (300, 361, 480, 495, 496, 497, 530, 599, 600, 601, 650, 1300, 1316, 1439, 1440, 1499, 1500, 1600):
        now = utc(DAY, m)
        want = batch(occ, loads, now)
        got = {r["institution"]: r["status"] for r in statuses_at(out, now).collect()}
        for n, w, *_ in CASES:
            # before its window a delivery is not opened yet, and counts as pending
            assert got.get(n, "PENDING") == want[n], (m, n)
        seen |= set(want.values())
    assert seen == {"PENDING", "AT_RISK", "MISSING", "RECEIVED", "LATE"}
    per = out.groupBy("institution", "status").count().filter("count > 1 and status not in ('PENDING')")
    assert per.count() == 0


def test_wall_time(spark, tmp_path):
    """Without any further row the timers fire on the clock; a file withdraws them."""
    now = datetime.utcnow()
    at = lambda s: now + timedelta(seconds=s)
    rows = [(n, "daily", DAY, "due", at(0), at(d), at(r), None) for n, r, d in (("a", 1, 2), ("b", 1, 9000), ("c", 8000, 9000), ("d", 8000, 9000))]
    rows += [("d", "daily", DAY, "load", at(1), None, None, None)]
    spark.createDataFrame(rows, INPUT).coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(INPUT).parquet(str(tmp_path / "in"))
    q = stream_deadlines(src).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    got, until = {}, time.time() + 60
    while time.time() < until and (got.get("a"), got.get("b")) != ("MISSING", "AT_RISK"):
        time.sleep(1)
        try:
            got = {r["institution"]: r["status"] for r in statuses_at(spark.read.schema("institution STRING, slot_key STRING, business_date DATE, status STRING, at TIMESTAMP").parquet(str(tmp_path / "out")), at(7000)).collect()}
        except Exception:  # noqa: BLE001 - nothing written yet
            continue
    q.stop()
    assert got == {"a": "MISSING", "b": "AT_RISK", "c": "PENDING", "d": "RECEIVED"}
