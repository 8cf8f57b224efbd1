"""The live monitor against a replay of the same files, deduplication and deadline timers."""

from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from build import contract, contracts, load, loads, utc
from tidewatch.operators.replay import alert_codes, replay
from tidewatch.streaming.ingest import Intake, read_load_stream, stream_ingest
from tidewatch.streaming.monitor import Monitor, build_monitor_stream

FIRST = date(2026, 9, 1)


def month():
    rows, n = [], 0
    for name in ("a", "b"):
        for i in range(28):
            d = FIRST + timedelta(days=i)
            if d.isoweekday() > 5 or (name == "b" and i == 14):
                continue
            rows.append(load(n, name, utc(d, 450 + 7 * (i % 5) + (200 if i == 21 else 0)), 1000 + 10 * (i % 7), content="same-content" if i in (8, 9) else None))
            n += 1
    return rows


def test_monitor_equals_replay(spark, tr_calendar, tmp_path):
    rows = month()
    c = contracts(spark, [contract("a"), contract("b")])
    inst = spark.createDataFrame([("a", 1), ("b", 2)], "institution STRING, tier INT")
    src = str(tmp_path / "in")
    half = [r for r in rows if r[3] < datetime(2026, 9, 16)]
    # The second delivery of files repeats some of the first: they are already known.
    for k, part in enumerate((half, [r for r in rows if r not in half] + half[:3])):
        loads(spark, part).coalesce(1).write.mode("append").parquet(src)
        m = Monitor(spark, str(tmp_path / "out"), c, tr_calendar, inst)
        q = build_monitor_stream(m, read_load_stream(spark, src), str(tmp_path / "cp"))
        q.awaitTermination()
        assert q.exception() is None, k
    end = datetime(2026, 9, 28, 23)
    m.sweep(end, 0)
    assert m.loads().count() == len(rows)
    live = {
        (r["institution"], r["business_date"]): (r["status"], r["codes"])
        for r in m.latest_decisions().select("institution", "business_date", "status", alert_codes(F.col("findings")).alias("codes")).collect()
    }
    whole = replay(loads(spark, rows), c, tr_calendar, FIRST, date(2026, 9, 28), end)
    want = {(r["institution"], r["business_date"]): (r["status"], r["codes"]) for r in whole.select("institution", "business_date", "status", alert_codes(F.col("findings")).alias("codes")).collect()}
    both = {k: (live[k], want[k]) for k in want if k in live}
    assert len(both) >= 38 and all(a == b for a, b in both.values()), {k: v for k, v in both.items() if v[0] != v[1]}
    assert want[("b", FIRST + timedelta(days=14))][0] == "MISSING"


def test_older_file_after_newer_ones(spark, tr_calendar, tmp_path):
    """A batch with only an older file is judged at the time already reached, and its decision is the latest."""
    rows = [r for r in month() if r[1] == "a"]
    old = rows[5]
    c = contracts(spark, [contract("a")])
    m = Monitor(spark, str(tmp_path / "out"), c, tr_calendar, spark.createDataFrame([("a", 1)], "institution STRING, tier INT"))
    m.on_loads(loads(spark, [r for r in rows if r is not old]), 0)
    key = F.col("business_date") == F.lit(old[3].date())
    before = m.latest_decisions().filter(key).first()
    m.on_loads(loads(spark, [old]), 1)
    after = m.latest_decisions().filter(key).first()
    assert before["status"] == "MISSING" and after["status"] == "RECEIVED"
    assert after["judged_at"] == before["judged_at"]


def test_ingest_once(spark, tmp_path):
    rows = [load(i, "a", utc(FIRST, 450 + i), 10) for i in range(5)]
    rows += [rows[0][:3] + (rows[0][3] + timedelta(minutes=5),) + rows[0][4:], load(9, "unknown", utc(FIRST, 450), 10)]
    loads(spark, rows).coalesce(1).write.parquet(str(tmp_path / "in"))
    intake = Intake(spark, str(tmp_path / "out"), spark.createDataFrame([("a",)], "institution STRING"))
    q = stream_ingest(read_load_stream(spark, str(tmp_path / "in")), intake, str(tmp_path / "cp"))
    q.awaitTermination()
    assert sorted(r["external_id"] for r in intake.loads().collect()) == [f"x{i}" for i in range(5)]
    assert [r["violations"] for r in intake.rejected().collect()] == [["unknown_institution"]]
