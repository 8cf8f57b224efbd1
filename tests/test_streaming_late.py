"""Streams keep late files and know ids and contents however old."""

from datetime import date, timedelta

from pyspark.sql import functions as F

from build import contract, contracts, load, loads, utc
from tidewatch.operators.replay import alert_codes, history_depth
from tidewatch.streaming.ingest import Intake, read_load_stream, stream_ingest
from tidewatch.streaming.monitor import Monitor

FIRST = date(2026, 9, 1)


def test_ingest_keeps_late_files_and_old_ids(spark, tmp_path):
    inst = spark.createDataFrame([("a",)], "institution STRING")
    at = lambda days: utc(FIRST + timedelta(days=days), 450)
    for part in ([load(0, "a", at(0), 10), load(1, "a", at(40), 10)], [load(2, "a", at(3), 10)], [load(0, "a", at(60), 10), load(3, "a", at(61), 10)]):
        loads(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        intake = Intake(spark, str(tmp_path / "out"), inst)  # a new start each time
        stream_ingest(read_load_stream(spark, str(tmp_path / "in")), intake, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["external_id"] for r in intake.loads().collect()) == ["x0", "x1", "x2", "x3"]
    assert [(r["external_id"], r["violations"], r["received_at"]) for r in intake.rejected().collect()] == [("x0", ["repeated_external_id"], at(60))]


def test_monitor_knows_content_older_than_its_history(spark, tr_calendar, tmp_path):
    c = contracts(spark, [contract("a")])
    m = Monitor(spark, str(tmp_path / "out"), c, tr_calendar, spark.createDataFrame([("a", 1)], "institution STRING, tier INT"))
    old = FIRST - timedelta(days=history_depth(c) + 60)
    m.on_loads(loads(spark, [load(0, "a", utc(old, 450), content="same-content")]), 0)
    m.on_loads(loads(spark, [load(1, "a", utc(FIRST, 450), content="same-content")]), 1)
    row = m.latest_decisions().filter(f"business_date = date'{FIRST}'").select(alert_codes(F.col("findings")).alias("codes")).first()
    assert "DUPLICATE_FILE" in row["codes"]
