"""Incident lifecycle as a stream: one keyed state per delivery, its open and last incident by category.

Messages are decisions (all categories of a delivery that alert now), verdicts, links to an outage and incidents
known from before. They give a changelog: every change of an incident is one row with the incident's columns after
it and a number that counts up, so writing the log again, or folding it in any order, gives the same incidents.

A new incident of high priority waits ``fixed.NOTIFY_DELAY_MIN`` minutes. The timer looks at the state when it fires:
what healed, was decided or was linked to an outage in the meantime sends nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidewatch import fixed
from tidewatch.operators.incidents import CASE, incident_candidates, with_suppression
from tidewatch.operators.evaluate import KEY

CANDIDATE = "STRUCT<category: STRING, codes: ARRAY<STRING>, severity: STRING, priority: STRING, title: STRING, impact_customers: DOUBLE, impact_amount: DOUBLE>"
MESSAGE = (
    "institution STRING, slot_key STRING, business_date DATE, kind STRING, at TIMESTAMP, "
    f"candidates ARRAY<{CANDIDATE}>, suppression_id BIGINT, category STRING, incident_id BIGINT, codes ARRAY<STRING>, severity STRING, priority STRING, "
    "status STRING, resolution STRING, parent_id BIGINT, actor STRING"
)
CHANGE = (
    "institution STRING, slot_key STRING, business_date DATE, category STRING, incident_id BIGINT, seq BIGINT, kind STRING, at TIMESTAMP, actor STRING, "
    "codes ARRAY<STRING>, previous_codes ARRAY<STRING>, severity STRING, priority STRING, status STRING, resolution STRING, parent_id BIGINT, suppressed_by BIGINT, "
    "title STRING, impact_customers DOUBLE, impact_amount DOUBLE, opened_at TIMESTAMP, resolved_at TIMESTAMP"
)
STATE = (
    "incident_id BIGINT, seq BIGINT, opened INT, codes STRING, severity STRING, priority STRING, parent_id BIGINT, opened_us BIGINT, title STRING, "
    "customers DOUBLE, amount DOUBLE, last_codes STRING, last_resolution STRING, last_us BIGINT, notify_ms BIGINT"
)
FIELDS = [f.split()[0] for f in STATE.split(", ")]
#: Order of messages of one instant.
RANK = {"incident": 0, "verdict": 1, "decision": 2, "link": 3}
DELAY_MS = fixed.NOTIFY_DELAY_MIN * 60_000


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state lies on disk; queries with timers need this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def new_id(*parts: object) -> int:
    """The same opening has the same id on every run."""
    return int.from_bytes(hashlib.blake2b("|".join(map(str, parts)).encode(), digest_size=8).digest(), "big") >> 1


def micros(t: datetime) -> int:
    return int(pd.Timestamp(t).value // 1000)


def lower(priority: str) -> str:
    return f"P{min(4, int(priority[1]) + 1)}"


def listed(codes: object) -> list[str] | None:
    return None if codes is None else [str(c) for c in codes]


class Cases(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cases = handle.getMapState("cases", "category STRING", STATE)

    # --- state --------------------------------------------------------------------------------------------------

    def _load(self) -> dict[str, dict]:
        return {k[0]: dict(zip(FIELDS, v, strict=True)) for k, v in self.cases.iterator()}

    def _store(self, before: dict[str, dict], now: dict[str, dict]) -> None:
        for category, case in now.items():
            if case != before.get(category):
                self.cases.updateValue((category,), tuple(case[f] for f in FIELDS))
        was = {c["notify_ms"] for c in before.values()} - {None}
        wanted = {c["notify_ms"] for c in now.values()} - {None}
        for ms in was - wanted:  # withdrawn
            self.handle.deleteTimer(ms)
        for ms in wanted - was:
            self.handle.registerTimer(ms)

    # --- what happens to one delivery ---------------------------------------------------------------------------

    def _change(self, category: str, case: dict, kind: str, us: int, actor: str = "system", **more: object) -> dict:
        case["seq"] += 1
        open_now = case["codes"] is not None
        stamp = lambda x: None if x is None else pd.Timestamp(x, unit="us")
        row = {
            "category": category, "incident_id": case["incident_id"], "seq": case["seq"], "kind": kind, "at": stamp(us), "actor": actor,
            "codes": case["codes"].split(",") if open_now else case["last_codes"].split(","), "previous_codes": None, "severity": case["severity"], "priority": case["priority"],
            "status": "OPEN" if open_now else "RESOLVED", "resolution": None if open_now else case["last_resolution"], "parent_id": case["parent_id"], "suppressed_by": None,
            "title": case["title"], "impact_customers": case["customers"], "impact_amount": case["amount"], "opened_at": stamp(case["opened_us"]), "resolved_at": None if open_now else stamp(case["last_us"]),
        }
        return row | more

    @staticmethod
    def _close(case: dict, resolution: str, us: int) -> None:
        case.update(last_codes=case["codes"], last_resolution=resolution, last_us=us, codes=None, notify_ms=None)

    def _decision(self, key: tuple, cases: dict[str, dict], m: dict, us: int, clock_ms: int) -> Iterator[dict]:
        found = {c["category"]: c for c in (m["candidates"] if m["candidates"] is not None else [])}
        for category in sorted(found):
            c = found[category]
            codes = ",".join(c["codes"])
            case = cases.setdefault(category, dict.fromkeys(FIELDS) | {"seq": 0, "opened": 0})
            if case["codes"] is not None:
                if (codes, c["severity"]) == (case["codes"], case["severity"]):
                    continue
                was = case["codes"].split(",")
                priority = c["priority"] if case["parent_id"] is None else lower(c["priority"])
                case.update(codes=codes, severity=c["severity"], priority=priority, title=c["title"], customers=c["impact_customers"], amount=c["impact_amount"])
                yield self._change(category, case, "UPDATED", us, previous_codes=was)
                continue
            decided = case["last_codes"] is not None and case["last_resolution"] != "AUTO_CLEARED" and set(c["codes"]) <= set(case["last_codes"].split(","))
            if decided:
                continue
            case.update(incident_id=new_id(*key, category, case["opened"]), seq=0, opened=case["opened"] + 1, codes=codes, severity=c["severity"], priority=c["priority"])
            case.update(parent_id=None, opened_us=us, title=c["title"], customers=c["impact_customers"], amount=c["impact_amount"])
            if m["suppression_id"] is None and c["priority"] in ("P1", "P2"):
                case["notify_ms"] = clock_ms + DELAY_MS
            yield self._change(category, case, "OPENED", us)
            if m["suppression_id"] is not None:
                self._close(case, "SUPPRESSED", us)
                yield self._change(category, case, "SUPPRESSED", us, suppressed_by=m["suppression_id"])
        for category in sorted(set(cases) - set(found)):
            case = cases[category]
            if case["codes"] is not None:
                self._close(case, "AUTO_CLEARED", us)
                yield self._change(category, case, "AUTO_RESOLVED", us)

    def _known(self, cases: dict[str, dict], m: dict, us: int) -> None:
        """An incident from before: the lowest open one of a category, and its latest resolution."""
        case = cases.setdefault(m["category"], dict.fromkeys(FIELDS) | {"seq": 0, "opened": 0})
        codes = ",".join(m["codes"])
        if m["status"] != "RESOLVED":
            if case["codes"] is None or m["incident_id"] < case["incident_id"]:
                case.update(incident_id=m["incident_id"], codes=codes, severity=m["severity"], priority=m["priority"], parent_id=m["parent_id"], opened_us=us)
        elif case["last_us"] is None or (us, codes.split(","), m["resolution"]) > (case["last_us"], case["last_codes"].split(","), case["last_resolution"]):
            case.update(last_codes=codes, last_resolution=m["resolution"], last_us=us)

    def _message(self, key: tuple, cases: dict[str, dict], m: dict, clock_ms: int) -> Iterator[dict]:
        us = micros(m["at"])
        if m["kind"] == "decision":
            yield from self._decision(key, cases, m, us, clock_ms)
        elif m["kind"] == "incident":
            self._known(cases, m, us)
        elif m["kind"] == "verdict":
            case = cases.get(m["category"])
            if case is not None and case["codes"] is not None:
                self._close(case, m["resolution"], us)
                yield self._change(m["category"], case, "RESOLVED", us, actor=m["actor"])
        elif m["kind"] == "link":
            for category, case in sorted(cases.items()):
                if case["codes"] is not None and case["parent_id"] is None:
                    case.update(parent_id=m["parent_id"], priority=lower(case["priority"]), notify_ms=None)
                    yield self._change(category, case, "LINKED", us)

    # --- Spark's side -------------------------------------------------------------------------------------------

    def _frame(self, key: tuple, rows: list[dict]) -> pd.DataFrame:
        out = pd.DataFrame([dict(zip(KEY, key, strict=True)) | r for r in rows], columns=[*KEY, *COLUMNS])
        for c in ("at", "opened_at", "resolved_at"):
            out[c] = pd.to_datetime(out[c])
        for c in ("incident_id", "seq", "parent_id", "suppressed_by"):
            out[c] = out[c].astype("Int64")
        return out

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        messages = [m for pdf in rows for m in pdf.astype(object).where(pdf.notna(), None).to_dict("records")]
        messages.sort(key=lambda m: (m["at"], RANK[m["kind"]]))
        before = self._load()
        cases = {k: dict(v) for k, v in before.items()}
        out = []
        for m in messages:
            for c in ("incident_id", "parent_id", "suppression_id"):
                m[c] = None if m[c] is None else int(m[c])
            m["codes"] = listed(m["codes"])
            # On wall time the delay counts from now, on event time from the decision.
            clock_ms = timerValues.getCurrentProcessingTimeInMs() if self.wall_time else micros(m["at"]) // 1000
            out += self._message(key, cases, m, clock_ms)
        self._store(before, cases)
        if out:
            yield self._frame(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ms = expiredTimerInfo.getExpiryTimeInMs()
        out = []
        for category, case in sorted(self._load().items()):
            if case["notify_ms"] != ms:
                continue
            case["notify_ms"] = None
            if case["codes"] is not None and case["parent_id"] is None and case["priority"] in ("P1", "P2"):
                out.append(self._change(category, case, "NOTIFY", ms * 1000))
            self.cases.updateValue((category,), tuple(case[f] for f in FIELDS))
        if out:
            yield self._frame(key, out)

    def close(self) -> None:
        pass

    def __init__(self, wall_time: bool):
        self.wall_time = wall_time


COLUMNS = [f.split()[0] for f in CHANGE.split(", ")][len(KEY) :]


def message(rows: DataFrame, **values: Column) -> DataFrame:
    """Rows with the columns of a message; what is not given is null."""
    shape = rows.sparkSession.createDataFrame([], MESSAGE).schema
    return rows.select(*[(values[f.name] if f.name in values else F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in shape])


def decision_messages(evaluated: DataFrame, candidates: DataFrame, suppressions: DataFrame, at: Column) -> DataFrame:
    """One message per evaluated delivery with everything that alerts on it now, also where nothing does."""
    has = lambda c: F.col(c) if c in candidates.columns else F.lit(None)
    one = F.struct("category", "codes", "severity", "priority", has("title").cast("string").alias("title"), has("impact_customers").cast("double").alias("impact_customers"), has("impact_amount").cast("double").alias("impact_amount"))
    found = candidates.groupBy(*KEY).agg(F.array_sort(F.collect_list(one)).alias("candidates"))  # one per category at most
    rows = with_suppression(evaluated.select(*KEY, at.alias("at")).join(found, KEY, "left"), suppressions, at)
    return message(rows, kind=F.lit("decision"))


def messages_of(judged: DataFrame, institutions: DataFrame, suppressions: DataFrame, at: Column) -> DataFrame:
    """Decisions as they come out of ``evaluate``."""
    return decision_messages(judged, incident_candidates(judged, institutions), suppressions, at)


def incident_messages(incidents: DataFrame) -> DataFrame:
    """Incidents that were opened or resolved before the stream began."""
    at = F.when(F.col("status") == "RESOLVED", F.col("resolved_at")).otherwise(F.col("opened_at"))
    return message(incidents.filter(F.col("business_date").isNotNull()), kind=F.lit("incident"), at=at)


def verdict_messages(closed: DataFrame) -> DataFrame:
    """What ``apply_verdicts`` closed: (CASE, resolution, resolved_at, resolved_by)."""
    return message(closed.filter("closed_now and business_date is not null"), kind=F.lit("verdict"), at=F.col("resolved_at"), actor=F.col("resolved_by"))


def link_messages(linked: DataFrame, at: Column) -> DataFrame:
    """What ``group_systemic`` linked to a parent."""
    return message(linked.filter("linked").select(*KEY, "parent_id").distinct(), kind=F.lit("link"), at=at)


def stream_reconcile(messages: DataFrame, time_mode: str = "ProcessingTime", delay: str = "0 seconds") -> DataFrame:
    """Changelog of incidents. With event time, notifications wait for the watermark of the messages."""
    use_rocksdb(messages.sparkSession)
    timed = messages.withWatermark("at", delay) if time_mode == "EventTime" else messages
    return timed.groupBy(*KEY).transformWithStateInPandas(statefulProcessor=Cases(time_mode == "ProcessingTime"), outputStructType=CHANGE, outputMode="Append", timeMode=time_mode)


def write_changelog(changes: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Each batch under its number: a batch that is run again replaces what it wrote.

    ``available_now`` is for event time; on wall time a query goes on for its timers and is stopped by its owner.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = changes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")).start()


def read_changelog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{CHANGE}, batch_id BIGINT").parquet(path)


def fold(changes: DataFrame) -> DataFrame:
    """The incidents after a changelog: the row with the highest number of each. Order and repetition do not matter."""
    rest = [c for c in COLUMNS if c not in ("category", "incident_id", "kind", "actor", "previous_codes", "seq")]
    return changes.groupBy(*CASE, "incident_id").agg(F.max_by(F.struct("seq", *rest), "seq").alias("r"), F.max("suppressed_by").alias("suppressed_by_any")).select(
        *CASE, "incident_id", "r.seq", *[F.col(f"r.{c}") for c in rest if c != "suppressed_by"], F.col("suppressed_by_any").alias("suppressed_by")
    )


def upsert_incidents(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """``stored`` (the columns of ``fold``) after more of the changelog; applying the same changes again changes nothing."""
    new = fold(changes).select(*stored.columns)
    return stored.unionByName(new).groupBy(*CASE, "incident_id").agg(F.max_by(F.struct(*[c for c in stored.columns if c not in (*CASE, "incident_id")]), "seq").alias("r")).select(*CASE, "incident_id", "r.*")


