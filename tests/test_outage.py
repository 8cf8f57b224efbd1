"""Outages: the running series against the rule at each instant, and the sweep over all past instants."""

import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from tidewatch.operators import incidents as I
from tidewatch.streaming.deadlines import INPUT, stream_deadlines
from tidewatch.streaming.outage import OutageSeries, stream_systemic

DAY = date(2026, 9, 16)
T0 = datetime(2026, 9, 16, 6)
OCC = "institution STRING, slot_key STRING, business_date DATE, expected BOOLEAN, deadline_utc TIMESTAMP, first_received_at TIMESTAMP"


def deliveries(n, seed, spread=300):
    """(name, deadline, first file or None); a third share one deadline."""
    r = random.Random(seed)
    out = []
    for k in range(n):
        dl = T0 + timedelta(minutes=60 if k % 3 == 0 else r.randrange(spread))
        came = None if r.random() < 0.4 else dl + timedelta(minutes=r.randrange(-60, 200))
        out.append((f"i{k}", dl, came))
    return out


def at_instant(spark, rows, now):
    seen = [(n, "daily", DAY, True, dl, came if came and came <= now else None) for n, dl, came in rows]
    occ = spark.createDataFrame(seen, OCC).withColumn("status", F.when(F.col("first_received_at").isNull() & (F.col("deadline_utc") <= F.lit(now)), "MISSING").otherwise("X"))
    return [(r["due"], r["missing"], r["window_start"], r["window_end"]) for r in I.detect_systemic(occ, F.lit(now)).collect()]


def test_series_equals_the_rule(spark, tmp_path):
    rows = deliveries(60, 5)
    due = [(n, "daily", DAY, "due", dl - timedelta(hours=2), dl, None, None) for n, dl, _ in rows]
    files = [(n, "daily", DAY, "load", came, None, None, None) for n, _, came in rows if came]
    files += [(n, "daily", DAY, "load", came + timedelta(minutes=5), None, None, None) for n, _, came in rows[::4] if came]  # more files, some ahead of the first
    random.Random(1).shuffle(files)
    clock = [("~", "", DAY, "clock", T0 + timedelta(minutes=m), None, None, None) for m in (90, 200, 2000)]
    parts = [due + files[:20] + clock[:1], files[20:40] + clock[1:2], files[40:], clock[2:]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, INPUT).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        src = spark.readStream.schema(INPUT).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        series = OutageSeries(spark, str(tmp_path / "series"), fold=2)  # folds on the way
        # files reported hours late still count: the watermark leaves them a day
        q = stream_systemic(stream_deadlines(src, "EventTime", "1 day"), series, str(tmp_path / "cp"))
        q.awaitTermination()
        assert q.exception() is None
    spark.createDataFrame([("~", "", DAY, "clock", T0 + timedelta(days=3), None, None, None)], INPUT).coalesce(1).write.parquet(str(tmp_path / "in/end"))
    src = spark.readStream.schema(INPUT).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    stream_systemic(stream_deadlines(src, "EventTime", "1 day"), series, str(tmp_path / "cp")).awaitTermination()
    raised = 0
    for m in range(0, 420, 17):
        now = T0 + timedelta(minutes=m)
        got = [(r["due"], r["missing"], r["window_start"], r["window_end"]) for r in series.signal(now).collect()]
        assert got == at_instant(spark, rows, now), m
        raised += len(got)
    assert 3 < raised < 25


def brute(rows, minutes=90):
    out = []
    for t in sorted({dl for _, dl, _ in rows}):
        near = [(dl, came) for _, dl, came in rows if t - timedelta(minutes=minutes) <= dl <= t]
        missing = sum(came is None or came > t for _, came in near)
        if missing >= 3 and missing / len(near) >= 0.5:
            out.append((t, len(near), missing))
    return out


def occ_frame(spark, rows):
    return spark.createDataFrame([(n, "daily", DAY, True, dl, came) for n, dl, came in rows], OCC)


def test_scan_against_brute_force(spark):
    for seed, n, spread in ((1, 200, 300), (2, 40, 2000), (3, 3, 10), (4, 0, 10)):
        rows = deliveries(n, seed, spread)
        rows += [(f"e{k}", dl, dl) for k, (_, dl, _) in enumerate(rows[:5])]  # files at the very deadline
        rows += [(f"w{k}", dl, dl + timedelta(minutes=90)) for k, (_, dl, _) in enumerate(rows[:9])]  # and at the window's end
        got = sorted(tuple(r) for r in I.scan_systemic(occ_frame(spark, rows)).collect())
        assert got == brute(rows)


def test_one_deadline_for_all(spark):
    """All deadlines at one instant: they meet as one row, combined before any shuffle, and files as one row per instant."""
    occ = spark.range(200000).select(
        F.concat(F.lit("i"), "id").alias("institution"), F.lit("daily").alias("slot_key"), F.lit(DAY).alias("business_date"), F.lit(True).alias("expected"), F.lit(T0).alias("deadline_utc"),
        F.when(F.col("id") % 3 == 0, F.lit(T0) + F.make_dt_interval(mins=(F.col("id") % 60).cast("int"))).alias("first_received_at"),
    )
    found = I.scan_systemic(occ)
    # of the files, every twentieth came at the deadline itself
    late = occ.filter("first_received_at is null or first_received_at > deadline_utc").count()
    assert [tuple(r) for r in found.collect()] == [(T0, 200000, late)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_running_sums(spark):
    rows = [(k * 7919 % 1009, k % 5 - 2) for k in range(1009)]
    got = I.running_sums(spark.createDataFrame(rows, "t BIGINT, v BIGINT").repartition(6), "t", ["v"]).collect()
    total, want = 0, {}
    for t, v in sorted(rows):
        total += v
        want[t] = total
    assert {r["t"]: r["v"] for r in got} == want
