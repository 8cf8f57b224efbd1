"""Streams over deliveries and incidents made of the given tables, run to the end of their input and read back."""

from __future__ import annotations

import uuid
from datetime import UTC, date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch import fixed
from tidewatch.functions.scalar import local_minutes
from tidewatch.operators.evaluate import KEY
from tidewatch.plans import q_arrivals as A
from tidewatch.plans import q_desk as Q
from tidewatch.plans import domain as D
from tidewatch.plans import sqltext as S
from tidewatch.plans.registry import ORACLES, query
from tidewatch.session import shared_dir
from tidewatch.streaming import cases as C
from tidewatch.streaming.deadlines import INPUT, OUTPUT, due_rows, load_rows, statuses_at, stream_deadlines
from tidewatch.streaming.deadlines import KEYS as DELIVERY
from tidewatch.streaming.ingest import Intake, read_load_stream, stream_ingest
from tidewatch.streaming.monitor import Monitor, build_monitor_stream
from tidewatch.streaming.outage import OutageSeries, stream_systemic

OCC = S.DESK_OCC
#: Deadlines at which the outage series is asked.
DESK_INSTANTS = [datetime(1995 + k % 6, 1 + k, 3 + 2 * k, 10, tzinfo=UTC) for k in range(12)]


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidewatch/live-{name}-{uuid.uuid4().hex}"


@query(
    "stream_reconcile",
    f"WITH {Q.RECON}, e AS (SELECT *, unnest(CASE action WHEN 'SUPPRESSED' THEN ['OPENED', 'SUPPRESSED'] ELSE [action] END) AS kind FROM ra WHERE action IN ('OPENED', 'SUPPRESSED', 'UPDATED', 'AUTO_RESOLVED')) "
    "SELECT institution, business_date, category, kind, array_to_string(CASE kind WHEN 'AUTO_RESOLVED' THEN oc ELSE cc END, ',') AS codes, CASE kind WHEN 'UPDATED' THEN array_to_string(oc, ',') END AS previous_codes, "
    "CASE WHEN kind = 'AUTO_RESOLVED' THEN os ELSE cs END AS severity, CASE WHEN kind = 'AUTO_RESOLVED' THEN op WHEN kind = 'UPDATED' AND parent_id IS NOT NULL THEN 'P4' ELSE cp END AS priority, "
    "CASE kind WHEN 'AUTO_RESOLVED' THEN 'AUTO_CLEARED' WHEN 'SUPPRESSED' THEN 'SUPPRESSED' END AS resolution FROM e",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The changelog of one round of decisions after a restart; the first start takes over the incidents known before."""
    _, cand, known = Q.recon_inputs(spark, sf)
    at = folder(spark, "reconcile")
    rounds = [C.incident_messages(known), C.decision_messages(Q.occ(spark, sf).select(*KEY), cand, Q.suppressions(spark, sf), Q.now())]
    for messages in rounds:
        messages.write.mode("append").parquet(f"{at}/in")
        src = spark.readStream.schema(C.MESSAGE).option("maxFilesPerTrigger", 10000).parquet(f"{at}/in")
        # Messages of the past must not be late: the known incidents are resolved up to days after the desk's instant.
        C.write_changelog(C.stream_reconcile(src, "EventTime", "60 days"), f"{at}/log", f"{at}/checkpoint").awaitTermination()
    log = C.read_changelog(spark, f"{at}/log")
    return log.select("institution", "business_date", "category", "kind", F.array_join("codes", ",").alias("codes"), F.array_join("previous_codes", ",").alias("previous_codes"), "severity", "priority", "resolution")


#: Instants at which the statuses are read back: after an evening window's start, before and after a morning deadline, at the end.
INSTANTS = [datetime(2024, 1, 10, 14, 20, tzinfo=UTC), datetime(2024, 1, 17, 4, 0, tzinfo=UTC), datetime(2024, 1, 17, 7, 20, tzinfo=UTC), datetime(2024, 2, 5, 12, tzinfo=UTC)]


def usual(start: Column, sender: Column, tz: Column) -> Column:
    """A usual arrival for senders, 1 to 10 minutes after the window's start."""
    p97 = (local_minutes(start, tz) + 1 + F.substring(sender, 2, 9).cast("int") - fixed.AT_RISK_MARGIN_MIN).cast("double")
    return F.struct((p97 - 20).alias("median"), (p97 - 5).alias("p90"), p97.alias("p97"), F.lit(30).alias("n"))


@query(
    "stream_deadlines",
    f"WITH RECURSIVE {A.WALK}, files AS (SELECT institution, p.slot AS slot, p.bd AS bd, received_at FROM walk JOIN arr USING (institution, load_id)), "
    f"ts AS (SELECT unnest([{', '.join(f'TIMESTAMP {str(t)[:19]!r}' for t in INSTANTS)}]) AS t), "
    "due AS (SELECT *, ws + to_minutes(2 + CAST(substr(institution, 2) AS INTEGER)) AS risk FROM cands WHERE bd BETWEEN DATE '2024-01-01' AND DATE '2024-01-31') "
    "SELECT c.institution, c.slot AS slot_key, c.bd AS business_date, epoch(t)::BIGINT AS at, CASE WHEN min(f.received_at) > dl THEN 'LATE' WHEN min(f.received_at) IS NOT NULL THEN 'RECEIVED' WHEN t >= dl THEN 'MISSING' WHEN t >= risk THEN 'AT_RISK' ELSE 'PENDING' END AS status "
    "FROM due c CROSS JOIN ts LEFT JOIN files f ON f.institution = c.institution AND f.slot = c.slot AND f.bd = c.bd AND f.received_at <= t GROUP BY c.institution, c.slot, c.bd, ws, dl, risk, t HAVING ws <= t OR min(f.received_at) IS NOT NULL",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Statuses of deliveries at several instants, from timers and files."""
    cand = A.candidates(spark, sf).filter(F.col("business_date").between(date(2024, 1, 1), date(2024, 1, 31)))
    due = due_rows(cand.withColumns({"expected": F.lit(True), "arrival": usual(F.col("window_start_utc"), F.col("institution"), F.col("timezone"))}))
    opened = due.select(*DELIVERY)
    rows = due.unionByName(load_rows(A.assigned(spark, sf)).join(opened, DELIVERY, "left_semi"))
    last = spark.createDataFrame([("", "", date(2024, 3, 1), "clock", datetime(2024, 3, 1, tzinfo=UTC), None, None, None)], INPUT)
    at = folder(spark, "deadlines")
    for part in (rows, last):  # the clock comes in a second start
        part.write.mode("append").parquet(f"{at}/in")
        src = spark.readStream.schema(INPUT).option("maxFilesPerTrigger", 10000).parquet(f"{at}/in")
        out = stream_deadlines(src, "EventTime").writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint")
        out.trigger(availableNow=True).start().awaitTermination()
    changes = spark.read.schema(OUTPUT).parquet(f"{at}/out")
    found = [statuses_at(changes, t).withColumn("at", F.lit(int(t.timestamp())).cast("long")) for t in INSTANTS]
    return reduce(DataFrame.unionByName, found).select(*DELIVERY, "at", "status")


@query(
    "stream_ingest",
    f"WITH {S.ARRIVALS}, x AS (SELECT *, event_type || '|' || k AS external_id FROM arr), o AS (SELECT institution, external_id, arg_min(load_id, (received_at, load_id)) AS load_id FROM x WHERE institution <> 'S9' GROUP BY ALL) "
    "SELECT x.institution, x.external_id, x.load_id, CASE WHEN x.institution = 'S9' THEN 'unknown_institution' WHEN o.load_id IS NULL THEN 'repeated_external_id' ELSE 'accepted' END AS outcome "
    "FROM x LEFT JOIN o ON o.institution = x.institution AND o.external_id = x.external_id AND o.load_id = x.load_id WHERE x.institution = 'S9' OR o.load_id IS NOT NULL OR x.received_at >= TIMESTAMP '2024-01-16' "
    "AND NOT EXISTS (FROM x y WHERE y.institution = x.institution AND y.external_id = x.external_id AND y.received_at >= TIMESTAMP '2024-01-16' AND (y.received_at, y.load_id) < (x.received_at, x.load_id))",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Two starts of the intake, each over half the month; ids repeat within a half (combined) and across (refused, the first of the half)."""
    e = D.table(spark, sf, "events").select(F.col("event_id").cast("string").alias("load_id"), "event_type")
    a = D.arrivals(spark, sf).join(e, "load_id").withColumn("external_id", F.concat_ws("|", "event_type", F.col("record_count").cast("string"))).drop("event_type")
    inst = a.select("institution").distinct().filter("institution <> 'S9'")
    at = folder(spark, "ingest")
    half = F.col("received_at") < F.lit(datetime(2024, 1, 16, tzinfo=UTC))
    for part in (a.filter(half), a.filter(~half)):
        part.write.mode("append").parquet(f"{at}/in")
        intake = Intake(spark, f"{at}/out", inst)
        stream_ingest(read_load_stream(spark, f"{at}/in", max_files=10000), intake, f"{at}/checkpoint").awaitTermination()
    taken = intake.loads().select("institution", "external_id", "load_id", F.lit("accepted").alias("outcome"))
    refused = intake.rejected().select("institution", "external_id", "load_id", F.get("violations", F.lit(0)).alias("outcome"))
    return taken.unionByName(refused)


@query("stream_assign_evaluate", ORACLES["evaluate_multi_slot"])
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The monitor over the month's files in two starts, then all deliveries again: the same decisions as judging all of them at once."""
    a = D.arrivals(spark, sf).withColumn("external_id", F.col("load_id"))
    inst = a.select("institution", F.lit(1).alias("tier")).distinct()
    at = folder(spark, "monitor")
    half = F.col("received_at") < F.lit(datetime(2024, 1, 16, tzinfo=UTC))
    for part in (a.filter(half), a.filter(~half)):
        part.write.mode("append").parquet(f"{at}/in")
        monitor = Monitor(spark, f"{at}/out", A.contracts(spark, sf), A.cal(spark, sf), inst)
        build_monitor_stream(monitor, read_load_stream(spark, f"{at}/in", max_files=10000), f"{at}/checkpoint").awaitTermination()
    monitor.judge_all(date(2024, 1, 1), date(2024, 1, 31), A.NOW)
    in_month = F.col("business_date").between(date(2024, 1, 1), date(2024, 1, 31)) | (F.col("load_count") > 0)
    return monitor.latest_decisions().filter(in_month & (F.col("status") != "PENDING")).select("institution", "slot_key", "business_date", "status", "load_count")


@query(
    "stream_systemic",
    f"WITH {OCC}, t AS (SELECT DISTINCT deadline_utc AS t FROM desk_occ WHERE expected), "
    "g AS (SELECT t, count(*) AS due, count(*) FILTER (first_received_at IS NULL OR first_received_at > t) AS missing FROM t JOIN desk_occ o ON o.expected AND o.deadline_utc BETWEEN t - INTERVAL 90 MINUTE AND t GROUP BY t) "
    "SELECT epoch(t)::BIGINT AS at, due, missing FROM g WHERE t IN (" + ", ".join(f"TIMESTAMP '{t:%Y-%m-%d %H:%M:%S}'" for t in DESK_INSTANTS) + ") AND missing >= 3 AND missing / due >= 0.5",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The outage series fed by the timers of all deliveries, asked at some deadlines."""
    o = Q.occ(spark, sf).filter("expected").withColumns({"timezone": F.lit("UTC"), "arrival": F.lit(None).cast("struct<p97: double>")})
    files = o.filter("first_received_at is not null").withColumn("received_at", F.col("first_received_at"))
    last = spark.createDataFrame([("", "", date(2003, 1, 1), "clock", datetime(2003, 1, 1, tzinfo=UTC), None, None, None)], INPUT)
    at = folder(spark, "systemic")
    series = OutageSeries(spark, f"{at}/series")
    for part in (due_rows(o).unionByName(load_rows(files)), last):
        part.write.mode("append").parquet(f"{at}/in")
        src = spark.readStream.schema(INPUT).option("maxFilesPerTrigger", 10000).parquet(f"{at}/in")
        stream_systemic(stream_deadlines(src, "EventTime"), series, f"{at}/checkpoint").awaitTermination()
    found = [series.signal(t).select(F.lit(int(t.timestamp())).cast("long").alias("at"), "due", "missing") for t in DESK_INSTANTS]
    return reduce(DataFrame.unionByName, found)
