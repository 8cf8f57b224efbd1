"""The given tables read as deliveries.

ship: line items are debt records, the supplier's nation is the sender, and a sender delivers up to two
files on each Monday and Thursday. Irregularities follow from arithmetic on keys and dates, so that SQL
can state the same rows.
arrivals: events are single files of ten senders over thirty days.
desk: orders are incidents, and customers' nations are the institutions they belong to.
"""

from __future__ import annotations

from datetime import UTC, date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewatch import fixed, schemas
from tidewatch.operators.calendar import calendar_dim
from tidewatch.session import broadcast_within
from tidewatch.sources.holidays import build_holidays, fixed_holidays, movable_holidays
from tidewatch.sources.records import summarize_records

FIRST_DAY, START, END = date(1995, 1, 1), date(1995, 3, 1), date(2001, 11, 12)
NOW = datetime(2001, 12, 1, 12, 0, tzinfo=UTC)
SHIP_SLOT = "twice"
MAX_SENDER_ROWS = 1_000_000  # suppliers with their nations (two short columns) that still travel to every executor


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def institutions(spark: SparkSession, sf: str) -> DataFrame:
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("n_name").alias("institution"),
        F.col("n_nationkey").alias("nk"),
        F.col("r_name").alias("sector"),
        (F.lit(1) + F.col("n_nationkey") % 3).alias("tier"),
        (F.col("n_nationkey") % 7 != 6).alias("active"),
    )


def holidays(spark: SparkSession, first_year: int = 1994, last_year: int = 2002) -> DataFrame:
    years = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("year"))
    return build_holidays(fixed_holidays(spark), movable_holidays(spark), years)


def calendar(spark: SparkSession, start: date = date(1994, 11, 1), end: date = date(2002, 2, 28)) -> DataFrame:
    return calendar_dim(spark, holidays(spark, start.year - 1, end.year + 1), start, end)


# --- ship --------------------------------------------------------------------------------------------


def next_delivery_day(day: Column) -> Column:
    """The Monday or Thursday on or after a date."""
    wait = F.array(*[F.lit(x) for x in (0, 2, 1, 0, 3, 2, 1)])
    return F.date_add(day, F.element_at(wait, F.weekday(day) + 1))


def ship_records(spark: SparkSession, sf: str) -> DataFrame:
    """One row per debt record with sender, delivery day, file part, amount and customer.

    Line items travel once, to their orders; nations are joined last, so that their names do not travel.
    """
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    price = F.col("l_extendedprice").cast("decimal(20,2)")
    amount = (
        F.when((F.col("l_linenumber") == 7) & (F.col("l_quantity") <= 5), F.lit(0).cast("decimal(20,2)"))
        .when((F.col("l_linenumber") == 1) & (F.col("l_quantity") == 1), -price)
        .otherwise(price)
    )
    return (
        li.join(broadcast_within(s, MAX_SENDER_ROWS), li.l_suppkey == s.s_suppkey)
        .drop("l_suppkey", "s_suppkey")
        .join(o, li.l_orderkey == o.o_orderkey)
        .join(n, F.col("s_nationkey") == n.n_nationkey)
        .select(
            F.col("n_nationkey").alias("nk"),
            F.col("n_name").alias("institution"),
            next_delivery_day(F.to_date("l_shipdate")).alias("bd"),
            (F.col("l_orderkey") % 2).cast("int").alias("part"),
            "l_orderkey",
            "l_linenumber",
            "o_custkey",
            amount.alias("amount"),
        )
    )


def code(nk: Column, day: Column) -> Column:
    """The number that decides which irregularity a delivery has."""
    return F.lit(31) * nk + F.datediff(day, F.lit(FIRST_DAY))


def ship_files(spark: SparkSession, sf: str) -> DataFrame:
    rec = ship_records(spark, sf)
    return summarize_records(rec, ["nk", "institution", "bd", "part"], "amount", "o_custkey", ["o_custkey"])


def ship_loads(spark: SparkSession, sf: str) -> DataFrame:
    f = ship_files(spark, sf).withColumn("h", code(F.col("nk"), F.col("bd")))
    scale = F.when(F.col("h") % 89 == 0, 100).otherwise(1)
    f = f.withColumns({c: (F.col(c) * scale).cast("decimal(20,2)") for c in ("total_amount", "max_amount")})
    before = W.partitionBy("institution", "part").orderBy("bd")
    facts = ["record_count", "total_amount", "customer_count", "zero_amount_count", "negative_amount_count", "duplicate_record_count", "max_amount"]
    resent, copied = F.col("h") % 53 == 0, (F.col("h") % 61 == 0) & (F.col("part") == 0)
    lagged = {c: F.when(resent, F.coalesce(F.lag(c).over(before), F.col(c))).otherwise(F.col(c)) for c in facts}
    lagged["content_hash"] = F.when(copied, F.coalesce(F.lag("content_hash").over(before), F.col("content_hash"))).otherwise(F.col("content_hash"))
    f = f.withColumns({"minute_seed": (F.col("record_count") * 17 + F.floor(F.abs("total_amount"))) % 90} | lagged)
    minute = (
        F.lit(420)
        + F.col("minute_seed")
        + 25 * F.col("part")
        + F.when(F.col("h") % 41 == 0, 200).when(F.col("h") % 43 == 0, -150).when(F.col("h") % 37 == 0, 75).otherwise(0)
    )
    key = F.concat_ws("|", F.col("nk").cast("string"), F.col("bd").cast("string"), F.col("part").cast("string"))
    at = F.timestamp_seconds(F.unix_date("bd").cast("long") * 86400 + minute.cast("long") * 60)
    return f.filter(F.col("h") % 97 != 0).select(
        key.alias("load_id"),
        "institution",
        key.alias("external_id"),
        at.alias("received_at"),
        "content_hash",
        F.lit(None).cast("string").alias("slot_hint"),
        *facts,
        F.lit("SFTP").alias("source"),
        at.alias("ingested_at"),
    )


def ship_contracts(spark: SparkSession, sf: str, sensitivity: str = "MEDIUM", cap: float = 250000.0) -> DataFrame:
    slot = (
        f"named_struct('key', '{SHIP_SLOT}', 'label', 'Haftada iki', 'cadence', 'WEEKLY', 'weekdays', array(1, 4), "
        "'month_days', cast(null as array<int>), 'last_business_day', false, 'holiday_shift', 'NONE', "
        "'window_start_min', 360, 'deadline_min', 600, 'grace_minutes', 0)"
    )
    watches = (
        f"array(named_struct('metric', 'avg_amount', 'sensitivity', '{sensitivity}', 'direction', 'BOTH'), "
        "named_struct('metric', 'total_amount', 'sensitivity', 'MEDIUM', 'direction', 'HIGH_ONLY'))"
    )
    limits = f"array(named_struct('id', 'cap', 'metric', 'total_amount', 'min', 1.0D, 'max', {cap}D, 'severity', 'WARNING', 'note', 'tavan'))"
    return institutions(spark, sf).select(
        "institution",
        F.lit(1).alias("version"),
        F.lit("APPROVED").alias("status"),
        F.lit(FIRST_DAY).alias("effective_from"),
        F.lit("UTC").alias("timezone"),
        F.lit("TR").alias("calendar"),
        F.expr(f"array({slot})").alias("slots"),
        F.expr(watches).alias("metrics"),
        F.expr(limits).alias("limits"),
        F.expr(schemas.DEFAULT_QUALITY_SQL).alias("quality"),
        F.expr(schemas.DEFAULT_LEARNING_SQL).alias("learning"),
    )


def ship_labels(expected: DataFrame, nations: DataFrame) -> DataFrame:
    """Analyst labels on some deliveries."""
    h = code(F.col("nk"), F.col("business_date"))
    label = F.when(h % 101 == 0, "EXCLUDE").when(h % 1009 == 0, "REGIME")
    return (
        expected.join(nations.select("institution", "nk"), "institution")
        .select("institution", "slot_key", "business_date", label.alias("label"))
        .filter("label is not null")
    )


def ship_truths(expected: DataFrame, nations: DataFrame) -> DataFrame:
    """The irregularities put into the deliveries, as labelled truths."""
    h = code(F.col("nk"), F.col("business_date"))
    kinds = F.array_compact(
        F.array(
            F.when(h % 97 == 0, "MISSING"),
            F.when(h % 89 == 0, "UNIT_SCALE"),
            F.when(h % 53 == 0, "STALE"),
            F.when(h % 61 == 0, "DUPLICATE_FILE"),
            F.when(h % 41 == 0, "LATE"),
            F.when(h % 1009 == 0, "LEVEL_SHIFT"),
        )
    )
    return (
        expected.join(nations.select("institution", "nk"), "institution")
        .select("institution", "slot_key", "business_date", F.explode(kinds).alias("kind"))
    )


# --- arrivals ----------------------------------------------------------------------------------------


def arrivals(spark: SparkSession, sf: str, senders: int = 10) -> DataFrame:
    """Every event as one file of sender user_id % senders."""
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    body = F.concat_ws("|", "event_type", k.cast("string"), F.floor("value").cast("bigint").cast("string"))
    ts = F.col("ts").cast("timestamp")
    return e.select(
        F.col("event_id").cast("string").alias("load_id"),
        F.concat(F.lit("S"), (F.col("user_id") % senders).cast("string")).alias("institution"),
        F.col("event_id").cast("string").alias("external_id"),
        ts.alias("received_at"),
        F.md5(body.cast("binary")).alias("content_hash"),
        F.when(F.col("event_type") == "signup", "evening").alias("slot_hint"),
        k.alias("record_count"),
        F.col("value").cast("decimal(20,2)").alias("total_amount"),
        (k - k % 3).alias("customer_count"),
        F.lit(0).cast("bigint").alias("zero_amount_count"),
        F.lit(0).cast("bigint").alias("negative_amount_count"),
        F.lit(0).cast("bigint").alias("duplicate_record_count"),
        F.col("value").cast("decimal(20,2)").alias("max_amount"),
        F.lit("API").alias("source"),
        F.lit(None).cast("string").alias("file_name"),
        ts.alias("ingested_at"),
    )


def arrival_contracts(senders: DataFrame) -> DataFrame:
    """Two daily slots on business days, and a weekly Saturday one for every second sender."""

    def slot(key: str, cadence: str, start: int, deadline: int, weekdays: str = "cast(null as array<int>)") -> str:
        return (
            f"named_struct('key', '{key}', 'label', '{key}', 'cadence', '{cadence}', 'weekdays', {weekdays}, "
            "'month_days', cast(null as array<int>), 'last_business_day', false, 'holiday_shift', 'NONE', "
            f"'window_start_min', {start}, 'deadline_min', {deadline}, 'grace_minutes', 15)"
        )

    daily = f"{slot('morning', 'BUSINESS_DAYS', 360, 600)}, {slot('evening', 'BUSINESS_DAYS', 1020, 1200)}"
    weekly = slot("weekly", "WEEKLY", 480, 720, "array(6)")
    odd = F.substring("institution", 2, 9).cast("int") % 2 == 1
    return senders.select(
        "institution",
        F.lit(1).alias("version"),
        F.lit("APPROVED").alias("status"),
        F.lit(date(2023, 1, 1)).alias("effective_from"),
        F.lit(fixed.DEFAULT_TIMEZONE).alias("timezone"),
        F.lit("TR").alias("calendar"),
        F.when(odd, F.expr(f"array({daily}, {weekly})")).otherwise(F.expr(f"array({daily})")).alias("slots"),
        F.expr("array(named_struct('metric', 'record_count', 'sensitivity', 'MEDIUM', 'direction', 'BOTH'))").alias("metrics"),
        F.expr(f"cast(array() as array<{schemas.LIMIT}>)").alias("limits"),
        F.expr(schemas.DEFAULT_QUALITY_SQL).alias("quality"),
        F.expr(schemas.DEFAULT_LEARNING_SQL).alias("learning"),
    )


# --- desk --------------------------------------------------------------------------------------------

DESK_NOW = datetime(2001, 8, 1, 12, 0, tzinfo=UTC)


def pick(key: Column, values: list) -> Column:
    """values[key % len(values)]"""
    return F.get(F.array(*[F.lit(v) for v in values]), (key % len(values)).cast("int"))


def desk_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    """One row per customer nation and order date, with a status and findings that follow from the orders."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    n = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("institution"))
    k = F.col("k")
    agg = (
        o.join(c.select("c_custkey", "c_nationkey"), o.o_custkey == F.col("c_custkey"))
        .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("institution", F.to_date("o_orderdate").alias("business_date"))
        .agg(F.min("o_orderkey").alias("k"), F.count("*").alias("load_count"), F.sum(F.col("o_totalprice").cast("decimal(20,2)")).alias("amount"))
    )
    deadline = F.timestamp_seconds(F.unix_date("business_date").cast("long") * 86400 + 36000)
    status = pick(k, ["RECEIVED", "RECEIVED", "LATE", "RECEIVED", "MISSING", "RECEIVED", "AT_RISK", "PENDING", "RECEIVED", "UNSCHEDULED"])
    return agg.withColumn("status", status).select(
        "institution",
        F.lit("daily").alias("slot_key"),
        "business_date",
        "status",
        (F.col("status") != "UNSCHEDULED").alias("expected"),
        F.when(F.col("status") != "UNSCHEDULED", deadline - F.expr("interval 4 hours")).alias("window_start_utc"),
        F.when(F.col("status") != "UNSCHEDULED", deadline).alias("deadline_utc"),
        F.when(~F.col("status").isin("MISSING", "AT_RISK", "PENDING"), deadline + F.make_dt_interval(mins=(k % 300 - 200).cast("int"))).alias("first_received_at"),
        F.when(F.col("status").isin("MISSING", "AT_RISK", "PENDING"), 0).otherwise(F.col("load_count")).cast("bigint").alias("load_count"),
        F.col("amount").cast("double").alias("total_amount"),
        pick(k, [None, "INFO", "WARNING", "CRITICAL", None]).alias("max_severity"),
        F.when(k % 4 == 0, F.array(F.lit("VOLUME_LOW"))).when(k % 4 == 1, F.array(F.lit("LATE_DELIVERY"), F.lit("NEGATIVE_AMOUNTS"))).otherwise(F.array().cast("array<string>")).alias("codes"),
        (k % 11 == 0).alias("excluded"),
        (k % 97 == 0).alias("regime_break"),
        F.when(k % 13 != 0, deadline + F.expr("interval 2 hours")).alias("evaluated_at"),
    )


DESK_CATEGORIES = ["TIMELINESS", "VOLUME", "QUALITY", "RULE"]


def desk_incidents(spark: SparkSession, sf: str) -> DataFrame:
    """One incident per order."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    n = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("nation"))
    k = F.col("o_orderkey")
    status = pick(k, ["OPEN", "RESOLVED", "RESOLVED", "ACKNOWLEDGED", "RESOLVED"])
    res = pick(k, ["TRUE_POSITIVE", "FALSE_POSITIVE", "EXPECTED_EVENT", "NEW_NORMAL", "DUPLICATE", "AUTO_CLEARED", "SUPPRESSED"])
    opened = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(mins=(k % 1440).cast("int"))
    acked = opened + F.make_dt_interval(mins=(k % 97 + 1).cast("int"))
    closed = opened + F.make_dt_interval(mins=(k % 2011 + 5).cast("int"), secs=(k % 60).cast("decimal(18,6)"))
    systemic = k % 50 == 0
    codes = (
        F.when(systemic, F.array(F.lit("SYSTEMIC_OUTAGE")))
        .when(k % 4 == 0, F.array(pick(k, ["MISSING_DELIVERY", "LATE_DELIVERY", "DELIVERY_AT_RISK"])))
        .when(k % 4 == 1, F.array(pick(k, ["VOLUME_LOW", "VOLUME_HIGH"])))
        .when(k % 4 == 2, F.array(F.lit("DUPLICATE_FILE"), F.lit("NEGATIVE_AMOUNTS")))
        .otherwise(F.array(F.lit("LIMIT_BREACH")))
    )
    return (
        o.join(c.select("c_custkey", "c_nationkey"), o.o_custkey == F.col("c_custkey"))
        .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        .withColumn("status", status)
        .select(
            k.alias("incident_id"),
            F.when(systemic, "SYSTEMIC").otherwise("OCCURRENCE").alias("kind"),
            F.when(~systemic, F.col("nation")).alias("institution"),
            F.when(~systemic, "daily").alias("slot_key"),
            F.when(~systemic, F.to_date("o_orderdate")).alias("business_date"),
            F.when(systemic, "TIMELINESS").otherwise(pick(k, DESK_CATEGORIES)).alias("category"),
            codes.alias("codes"),
            F.concat(F.lit("Olay "), F.coalesce(F.when(~systemic, F.col("nation")), F.lit("Sistemik")), F.lit(" "), k.cast("string")).alias("title"),
            F.when(k % 3 == 0, "CRITICAL").otherwise("WARNING").alias("severity"),
            F.concat(F.lit("P"), F.least(F.lit(4), F.substring("o_orderpriority", 1, 1).cast("int")).cast("string")).alias("priority"),
            "status",
            opened.alias("opened_at"),
            F.when(F.col("status") != "OPEN", acked).alias("acknowledged_at"),
            F.when(F.col("status") == "RESOLVED", closed).alias("resolved_at"),
            F.when(F.col("status") == "RESOLVED", res).alias("resolution"),
            F.when(k % 50 == 1, k - 1).alias("parent_id"),
            F.when(k % 5 != 0, (k % 90000).cast("double")).alias("impact_customers"),
            F.when(k % 5 > 1, F.col("o_totalprice")).alias("impact_amount"),
        )
    )
