"""The live monitor: each micro-batch matches its own files and judges the deliveries they touch.

What earlier files did is kept as state per delivery, not read again from the files: which deliveries are filled, their
sums, first arrival and repeated content. Matching a batch needs the deliveries around its days; judging needs the
deliveries of the touched senders as far back as a contract looks. So what a batch reads is bounded by the calendar and
does not grow with the history. Files count in the order in which they arrive at the stream; where that is the order of
receipt, decisions equal those of a replay. Every output is written under its batch's number and replaced when a batch
is run again.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from datetime import UTC, date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch import fixed, schemas
from tidewatch.operators.assign import assign_loads
from tidewatch.operators.contracts import contract_validity
from tidewatch.operators.evaluate import ENGINES, KEY, attach_spec, learn
from tidewatch.operators.incidents import incident_candidates
from tidewatch.operators.metrics import join_expected, metrics_struct, repeated_content
from tidewatch.operators.replay import MATCH_PAD, SPILL, alert_codes, history_depth
from tidewatch.operators.schedule import expand_schedule
from tidewatch.session import settle
from tidewatch.sources.loads import materialize
from tidewatch.streaming.cases import MESSAGE, decision_messages
from tidewatch.streaming.ingest import Intake
from tidewatch.streaming.store import Folders, Latest, Numbers, Seen

SUMS = "n BIGINT, amount DECIMAL(38,2), customers BIGINT, zero BIGINT, negative BIGINT, repeated BIGINT, files BIGINT, top DECIMAL(20,2)"
CAME = f"{SUMS}, first_received_at TIMESTAMP, first_version INT, load_timezone STRING, dup_load_id STRING, dup_hash STRING"
DUE = "window_start_utc TIMESTAMP, deadline_utc TIMESTAMP, timezone STRING, slot_label STRING, month_phase STRING, iso_weekday INT, expected BOOLEAN"
KEY_TYPES = "institution STRING, slot_key STRING, business_date DATE"
STATE = f"{KEY_TYPES}, {CAME}, {DUE}"
DECISION = f"{KEY_TYPES}, status STRING, max_severity STRING, load_count BIGINT, first_received_at TIMESTAMP, findings ARRAY<{schemas.FINDING}>, judged_at TIMESTAMP"
SHADOW = f"{KEY_TYPES}, challenger STRING, status STRING, codes ARRAY<STRING>, max_severity STRING, evaluated_at TIMESTAMP"
FAILED = "challenger STRING, error STRING, at TIMESTAMP"
LABEL = f"{KEY_TYPES}, label STRING"


def names(schema: str) -> list[str]:
    depth, out, word = 0, [], ""
    for ch in schema + ",":
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and not depth:
            out.append(word.split()[0])
            word = ""
        else:
            word += ch
    return out


def instant(us: int) -> datetime:
    return datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=us)


def sums_of(assigned: DataFrame, repeated: DataFrame) -> DataFrame:
    """What a batch's files add to each delivery."""
    t = F.col("received_at")
    got = (
        assigned.filter(F.col("slot_key").isNotNull())
        .groupBy(*KEY)
        .agg(
            F.sum("record_count").alias("n"),
            F.sum("total_amount").cast("decimal(38,2)").alias("amount"),
            F.sum("customer_count").alias("customers"),
            F.sum("zero_amount_count").alias("zero"),
            F.sum("negative_amount_count").alias("negative"),
            F.sum("duplicate_record_count").alias("repeated"),
            F.count("*").alias("files"),
            F.max("max_amount").alias("top"),
            F.min(t).alias("first_received_at"),
            F.min_by("version", t).alias("first_version"),
            F.min_by("timezone", t).alias("load_timezone"),
        )
    )
    return got.join(repeated, KEY, "left")


def merged(rows: DataFrame) -> DataFrame:
    """One row per delivery from what it was (``_age`` 0) and what is added (``_age`` 1)."""
    t = F.col("first_received_at")
    by_age = F.when(F.col("dup_load_id").isNotNull(), F.col("_age"))
    sums = [F.sum(c).cast(k).alias(c) for c, k in (("n", "bigint"), ("amount", "decimal(38,2)"), ("customers", "bigint"), ("zero", "bigint"), ("negative", "bigint"), ("repeated", "bigint"), ("files", "bigint"))]
    first = [F.min_by("first_version", t).alias("first_version"), F.min_by("load_timezone", t).alias("load_timezone")]
    dup = [F.min_by(c, by_age).alias(c) for c in ("dup_load_id", "dup_hash")]
    return rows.groupBy(*KEY).agg(*sums, F.max("top").alias("top"), F.min(t).alias("first_received_at"), *first, *dup)


def with_metrics(state: DataFrame) -> DataFrame:
    """State rows as occurrences with metrics; null where nothing came."""
    m = metrics_struct(*[F.col(c) for c in ("n", "amount", "customers", "zero", "negative", "repeated", "files", "top")])
    return state.withColumns({"metrics": F.when(F.col("files") > 0, m), "load_count": F.coalesce("files", F.lit(0).cast("bigint"))})


class Monitor:
    """Tables of one monitor and what to do with new files, deadlines and new days.

    ``labels`` (what analysts' verdicts teach) and ``suppressions`` are functions; they are read anew in every batch.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        contracts: DataFrame,
        cal: DataFrame,
        institutions: DataFrame,
        clock: Callable[[DataFrame], datetime] | None = None,
        labels: Callable[[], DataFrame] | None = None,
        suppressions: Callable[[], DataFrame] | None = None,
    ) -> None:
        self.spark, self.root = spark, root
        self.contracts, self.cal, self.institutions = contracts, cal, institutions
        self.validity = contract_validity(contracts)
        self.clock = clock or (lambda batch: batch.agg(F.max("received_at")).first()[0])
        self.labels = labels or (lambda: spark.createDataFrame([], LABEL))
        none = "suppression_id BIGINT, institution STRING, starts_at TIMESTAMP, ends_at TIMESTAMP, reason STRING"
        self.suppressions = suppressions or (lambda: spark.createDataFrame([], none))
        self.intake = Intake(spark, f"{root}/intake", institutions)
        self.state = Latest(spark, f"{root}/state", KEY, STATE, order="business_date")
        self.decisions = Latest(spark, f"{root}/decisions", KEY, DECISION, order="business_date")
        self.time = Latest(spark, f"{root}/time", ["name"], "name STRING, us BIGINT")
        self.contents = Seen(spark, f"{root}/contents", ["institution", "content_hash"], "institution STRING, content_hash STRING, first_seen_at TIMESTAMP")
        self.assigned = Folders(spark, f"{root}/assigned")
        self.messages = Folders(spark, f"{root}/messages")
        self.depth = history_depth(contracts)
        self.numbers = Numbers(spark, f"{root}/numbers")
        self.one_at_a_time = threading.Lock()  # files, sweeps and days come from queries of one driver

    # --- files ------------------------------------------------------------------------------------------------------

    def on_loads(self, batch: DataFrame, batch_id: int) -> None:
        """New files: keep those not seen before, match them, judge the deliveries of their senders around their days."""
        if batch.isEmpty():
            return
        with self.one_at_a_time:
            number = self._begin("loads", batch_id)
            fresh = self.intake.take(batch, number, tidy=False)
            first, last = fresh.agg(F.min(F.to_date("received_at")), F.max(F.to_date("received_at"))).first()
            if first is None:
                return
            now = self._advance(self.clock(batch), number)
            self._match(fresh, first, last, number)
            self._judge(fresh.select("institution").distinct(), first, now, number)

    def _begin(self, source: str, batch_id: int) -> int:
        """The number under which a batch writes; earlier numbers are what it may read."""
        number = self.numbers.of(source, batch_id)
        for t in (self.state, self.decisions, self.time, self.contents, self.intake.ids):
            t.tidy(self.numbers.settled("loads", "sweep"))
        return number

    def _advance(self, at: datetime, batch_id: int) -> datetime:
        """The batch's time, but never before that of an earlier batch: older files do not turn the clock back."""
        at = at.astimezone(UTC)  # what Spark hands to Python without a zone is in the driver's
        known = self.time.read(batch_id).first()
        us = max(round(at.timestamp() * 1e6), known["us"] if known else 0)
        self.time.write(self.spark.createDataFrame([("now", us)], "name STRING, us BIGINT"), batch_id)
        return instant(us)

    def _match(self, fresh: DataFrame, first: date, last: date, batch_id: int) -> None:
        """Assigns a batch's files, given which deliveries around its days are filled, and adds them to the deliveries."""
        lo, hi = first - MATCH_PAD, last + timedelta(days=2)
        day = F.col("business_date")
        around = settle(self.state.read(batch_id, day.between(lo, hi)), "around")
        senders = fresh.select("institution").distinct()
        validity = self.validity.join(senders, "institution", "left_semi")
        cand = settle(expand_schedule(validity, self.cal, lo, hi, SPILL), "candidates")
        assigned = settle(assign_loads(fresh, cand, validity, around.filter("files > 0")), "matched")
        self.assigned.write(assigned, batch_id)
        earlier = settle(self.contents.find(fresh.select("institution", "content_hash"), batch_id), "earlier")
        added = sums_of(assigned, repeated_content(assigned, earlier))
        came = names(f"{KEY_TYPES}, {CAME}")
        before = around.filter("files > 0").select(*came, F.lit(0).alias("_age")).join(added.select(*KEY), KEY, "left_semi")
        whole = merged(before.unionByName(added.select(*came, F.lit(1).alias("_age"))))
        expected = expand_schedule(validity, self.cal, lo, hi).join(whole.select(*KEY), KEY, "left_semi")
        occ = join_expected(expected, whole.withColumn("load_count", F.col("files")), cand, keep=("first_version", "load_timezone"))
        self.state.write(occ.select(*names(STATE)), batch_id)
        new = fresh.groupBy("institution", "content_hash").agg(F.min("received_at").alias("first_seen_at"))
        seen = earlier.groupBy("institution", "content_hash").agg(F.min("first_seen_at").alias("_seen"))
        first_time = new.join(seen, ["institution", "content_hash"], "left").filter("_seen is null or first_seen_at < _seen").drop("_seen")
        self.contents.add(first_time, batch_id)

    # --- judgement --------------------------------------------------------------------------------------------------

    def learned(self, senders: DataFrame, since: date, now: datetime, before: int | None, last: date | None = None) -> tuple[DataFrame, date]:
        """Deliveries of the senders from a few days before ``since`` on, with all that they are compared with."""
        reach = since - timedelta(days=fixed.LATE_LOOKBACK_DAYS + 1)
        day = F.col("business_date")
        stored = self.state.read(before, day >= F.lit(reach - timedelta(days=self.depth))).join(senders, "institution", "left_semi")
        stored = settle(stored, "deliveries")
        validity = self.validity.join(senders, "institution", "left_semi")
        expected = expand_schedule(validity, self.cal, reach, last or now.date() + timedelta(days=2))
        keep = ["dup_load_id", "dup_hash"]
        recent = with_metrics(stored.filter(day >= F.lit(reach)))
        due = names(DUE)
        open_now = expected.select(*KEY, *[c for c in due if c != "expected"], F.lit(True).alias("expected")).join(recent.select(*KEY), KEY, "left_anti")
        columns = [*KEY, *due, "metrics", "first_received_at", "load_count", *keep]
        whole = recent.select(*columns).unionByName(with_metrics(stored.filter(day < F.lit(reach)).filter("files > 0")).select(*columns)).unionByName(open_now, allowMissingColumns=True)
        occ = whole.withColumn("load_count", F.coalesce("load_count", F.lit(0).cast("bigint")))
        ready = F.col("window_start_utc").isNull() | (F.col("window_start_utc") <= F.lit(now)) | (F.col("load_count") > 0)
        contracts = self.contracts.join(senders, "institution", "left_semi")
        return settle(learn(attach_spec(occ.filter(ready), contracts), self.labels(), self.depth), "learned"), reach

    def _judge(self, senders: DataFrame, since: date, now: datetime, batch_id: int, changed_only: bool = False, last: date | None = None) -> None:
        rows, reach = self.learned(senders, since, now, batch_id + 1, last)
        judged = settle(ENGINES["champion"](rows, F.lit(now)).filter(F.col("business_date") >= F.lit(reach)), "judged")
        if changed_only:
            last = self.decisions.read(batch_id, F.col("business_date") >= F.lit(reach)).select(*KEY, F.col("status").alias("_status"), F.transform("findings", lambda f: f["code"]).alias("_codes"))
            same = (F.col("status") == F.col("_status")) & (F.transform("findings", lambda f: f["code"]) == F.col("_codes"))
            judged = settle(judged.join(last, KEY, "left").filter(~F.coalesce(same, F.lit(False))).drop("_status", "_codes"), "changed")
        self.decisions.write(judged.select(*names(DECISION)), batch_id)
        at = F.lit(now)
        self.messages.write(decision_messages(judged.select(*KEY), incident_candidates(judged, self.institutions), self.suppressions(), at), batch_id)

    def sweep(self, now: datetime, batch_id: int) -> None:
        """Deadlines pass without any file: judges the senders with deliveries that are due and did not come; keeps changes only."""
        with self.one_at_a_time:
            self._sweep(now, self._begin("sweep", batch_id))

    def _sweep(self, now: datetime, batch_id: int) -> None:
        now = self._advance(now, batch_id)
        day = now.date()
        due = expand_schedule(self.validity, self.cal, day - timedelta(days=1), day + timedelta(days=1)).filter(F.col("window_start_utc") <= F.lit(now))
        came = self.state.read(batch_id, F.col("business_date") >= F.lit(day - timedelta(days=1))).filter("files > 0")
        settled = self.decisions.read(batch_id, F.col("business_date") >= F.lit(day - timedelta(days=1))).filter("status = 'MISSING'")
        waiting = due.select(*KEY).join(came.select(*KEY), KEY, "left_anti").join(settled.select(*KEY), KEY, "left_anti")
        senders = settle(waiting.select("institution").distinct(), "waiting")
        self._judge(senders, day, now, batch_id, changed_only=True)

    def judge_all(self, first: date, last: date, now: datetime, batch_id: int = 0) -> None:
        """Judges every sender's deliveries from ``first`` on again, for example after verdicts; keeps changes only."""
        with self.one_at_a_time:
            number = self._begin("all", batch_id)
            senders = self.validity.select("institution").distinct()
            since = first + timedelta(days=fixed.LATE_LOOKBACK_DAYS + 1)
            self._judge(senders, since, self._advance(now, number), number, changed_only=True, last=last)

    def materialize(self, day: date, batch_id: int) -> None:
        """The day's deliveries as PENDING decisions before anything arrives; what is stored already stays."""
        with self.one_at_a_time:
            self._materialize(day, self._begin("days", batch_id))

    def _materialize(self, day: date, batch_id: int) -> None:
        active = self.institutions if "active" in self.institutions.columns else self.institutions.withColumn("active", F.lit(True))
        known = self.decisions.read(batch_id, F.col("business_date") == F.lit(day))
        new = materialize(expand_schedule(self.validity, self.cal, day, day), known, active, day)
        none = F.lit(None)
        rows = new.withColumns({"max_severity": none.cast("string"), "load_count": F.lit(0).cast("bigint"), "first_received_at": none.cast("timestamp"), "findings": F.array().cast(f"array<{schemas.FINDING}>"), "judged_at": F.lit(datetime.combine(day, datetime.min.time())).cast("timestamp")})
        self.decisions.write(rows.select(*names(DECISION)), batch_id)

    # --- reading ----------------------------------------------------------------------------------------------------

    def loads(self) -> DataFrame:
        return self.intake.loads()

    def latest_decisions(self) -> DataFrame:
        return self.decisions.read()

    def message_stream(self) -> DataFrame:
        """Input of ``stream_reconcile``."""
        return self.spark.readStream.schema(MESSAGE).option("recursiveFileLookup", "true").parquet(f"{self.root}/messages")


class Shadow:
    """Challengers on a monitor's inputs, as a second query on the same source with its own checkpoint.

    It reads the monitor's state and writes only its own tables. A challenger that raises is noted and leaves the others alone.
    """

    def __init__(self, monitor: Monitor, engines: dict[str, Callable[[DataFrame, object], DataFrame]]) -> None:
        self.monitor, self.engines = monitor, engines
        self.results = Latest(monitor.spark, f"{monitor.root}/shadow", [*KEY, "challenger"], SHADOW)
        self.failures = Folders(monitor.spark, f"{monitor.root}/shadow-failures")

    def on_loads(self, batch: DataFrame, batch_id: int) -> None:
        self.results.tidy(batch_id)
        m = self.monitor
        first = batch.agg(F.min(F.to_date("received_at"))).first()[0]
        known = m.time.read().first()
        if first is None or known is None:
            return
        senders = settle(batch.select("institution").distinct(), "shadow-senders")
        now = instant(known["us"])
        rows, reach = m.learned(senders, first, now, None)
        found, failed = [], []
        for name, engine in self.engines.items():
            try:
                got = engine(rows, F.lit(now)).filter(F.col("business_date") >= F.lit(reach))
                found.append(settle(got.select(*KEY, F.lit(name).alias("challenger"), "status", alert_codes(F.col("findings")).alias("codes"), "max_severity", F.col("judged_at").alias("evaluated_at")), "shadow"))
            except Exception as e:  # noqa: BLE001 - whatever a challenger does stays here
                failed.append((name, str(e)[:500], now))
        if found:
            out = found[0]
            for f in found[1:]:
                out = out.unionByName(f)
            self.results.write(out, batch_id)
        self.failures.write(m.spark.createDataFrame(failed, FAILED), batch_id)


def build_monitor_stream(monitor: Monitor | Shadow, source: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    writer = source.writeStream.foreachBatch(monitor.on_loads).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")).start()


def build_sweep_stream(monitor: Monitor, checkpoint: str, every: str = "30 seconds") -> StreamingQuery:
    """Wall-clock ticks: in a total outage no file arrives, so deadlines cannot wait for input."""
    ticks = monitor.spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def on_tick(batch: DataFrame, batch_id: int) -> None:
        now = batch.agg(F.max("timestamp")).first()[0]
        if now is not None:
            monitor.sweep(now, batch_id)

    return ticks.writeStream.foreachBatch(on_tick).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()

