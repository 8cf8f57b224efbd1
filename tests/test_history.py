"""Histories deeper than the common one, and month-long samples of the small operators."""

from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from tidewatch.operators.history import with_history
from tidewatch.session import broadcast_within, settle


def test_own_depth(spark):
    """Each row keeps what its contract's lookback allows, at least 400 days."""
    start = date(2024, 1, 1)
    rows = [(name, "d", start + timedelta(days=50 * i), depth) for name, depth in (("deep", 700), ("common", 180)) for i in range(16)]
    df = spark.createDataFrame(rows, "institution STRING, slot_key STRING, business_date DATE, look INT")
    df = df.withColumn("learning", F.struct(F.col("look").alias("lookback_days")))
    h = with_history(df, F.when(F.dayofmonth("business_date") > 0, F.unix_date("business_date")), days=700)
    last = {r["institution"]: len(r["history"]) for r in h.filter(F.col("business_date") == F.lit(start + timedelta(days=750))).collect()}
    assert last == {"deep": 14, "common": 8}


def test_settle_and_broadcast(spark):
    df = spark.createDataFrame([(1, datetime(2026, 1, 1))], "a INT, t TIMESTAMP")
    again = settle(df, "x")
    assert again.schema == df.schema and again.collect() == df.collect()
    plan = lambda d: d._jdf.queryExecution().logical().toString()
    assert "ResolvedHint" in plan(broadcast_within(df, 1)) or "UnresolvedHint" in plan(broadcast_within(df, 1))
    assert "Hint" not in plan(broadcast_within(df, 0))
