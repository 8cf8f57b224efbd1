"""Steps whose rows must not meet in one task, and summaries whose records travel once."""

from datetime import date

from build import contract, contracts, slot
from pyspark.sql import functions as F

from tidewatch.operators import incidents as I
from tidewatch.operators.schedule import expand_schedule
from tidewatch.sources.records import summarize_records


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_records_travel_once_to_their_customers(spark):
    rows = [("f", 1, 5), ("f", 1, 5), ("f", 1, -7), ("f", 2, 0), ("f", None, 3), ("f", None, None), (None, 2, 1), ("g", 2, 9), ("g", 3, 9)]
    rec = spark.createDataFrame(rows, "file STRING, customer BIGINT, amount INT").repartition(3).withColumn("twin", F.col("customer"))
    got = summarize_records(rec, ["file"], "amount", "customer", ["customer"])
    facts = ["record_count", "total_amount", "customer_count", "zero_amount_count", "negative_amount_count", "duplicate_record_count", "max_amount"]
    assert {r["file"]: tuple(int(r[c]) for c in facts) for r in got.collect()} == {"f": (6, 6, 2, 1, 1, 3, 5), None: (1, 1, 1, 0, 0, 0, 1), "g": (2, 18, 2, 0, 0, 0, 9)}
    other = summarize_records(rec, ["file"], "amount", "customer", ["twin"])  # the way of record keys that may span customers
    assert sorted(map(str, got.select("file", *facts).collect())) == sorted(map(str, other.select("file", *facts).collect()))
    same = summarize_records(rec, ["file"], "amount", "customer", ["customer"]).join(got.select("file", "content_hash"), ["file", "content_hash"])
    assert same.count() == 2  # files f and g; null meets nothing
    assert shuffles(summarize_records(rec, ["file"], "amount", "customer", ["customer"])) == 2  # records to their (file, customer), partial sums to their file


def test_incidents_without_parent_are_dealt_to_all_tasks(spark):
    inc = spark.range(2000).select(
        F.col("id").alias("incident_id"),
        F.when(F.col("id") == 0, "SYSTEMIC").otherwise("OCCURRENCE").alias("kind"),
        F.lit("OPEN").alias("status"),
        F.when(F.col("id") < 3, F.lit(0).cast("bigint")).alias("parent_id"),
        F.lit("VOLUME").alias("category"),
        F.lit("A").alias("institution"),
        F.lit("daily").alias("slot_key"),
        F.lit(date(2026, 9, 16)).alias("business_date"),
        F.lit(None).cast("string").alias("resolution"),
        F.lit(None).cast("timestamp").alias("resolved_at"),
    )
    v = spark.sql("SELECT 0L AS incident_id, 'a' AS actor, 'TRUE_POSITIVE' AS resolution, '' AS note, timestamp'2026-09-16 09:00:00' AS at")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        out = I.apply_verdicts(inc, v)[0].withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, x in kept.items():
            spark.conf.set(k, x)
    assert len(out) == 2000 and sorted(r["incident_id"] for r in out if r["closed_now"]) == [0, 1, 2]
    assert len({r["task"] for r in out if r["parent_id"] is None}) > 1


def test_contracts_are_dealt_before_their_days_are_made(spark, tr_calendar):
    c = contracts(spark, [contract(f"I{i}", [slot(cadence="EVERY_DAY"), slot("w", "WEEKLY", [1, 4])]) for i in range(64)]).coalesce(1)
    got = expand_schedule(c, tr_calendar, date(2026, 9, 14), date(2026, 9, 20))
    kept = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        plan = expand_schedule(c, tr_calendar, date(2026, 9, 14), date(2026, 9, 20))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)
    rows = {r["slot_key"]: r["count"] for r in got.groupBy("slot_key").count().collect()}
    assert rows == {"daily": 448, "w": 128}
    # below every step that makes days, contracts are dealt by institution
    assert plan.count("REPARTITION_BY_NUM") >= 1
