"""Per-delivery timers: what is expected, what came, what is at risk and what did not come by its deadline.

Each key is one delivery, so a sender's size does not matter. A delivery waits on up to three timers: the instant from
which it is later than usual (AT_RISK), the end of its local day where the deadline lies beyond it (PENDING again), and
the deadline (MISSING). Its file withdraws them. On wall time (the default) they fire although no row arrives at all,
as in a total outage, and no row is ever too late; on event time, for replays whose rows come in order, the watermark
of all rows moves them, so a clock (kind 'clock') may be mixed in.

A change also says by how much it changes the number of deliveries that are due, and of those that are missing, from its
instant or the deadline on (the later of them). A row with the status REVISED only takes back an earlier such change.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewatch import fixed
from tidewatch.functions.scalar import local_to_utc
from tidewatch.streaming.cases import use_rocksdb

KEYS = ["institution", "slot_key", "business_date"]
INPUT = "institution STRING, slot_key STRING, business_date DATE, kind STRING, at TIMESTAMP, deadline TIMESTAMP, risk TIMESTAMP, calm TIMESTAMP"
OUTPUT = "institution STRING, slot_key STRING, business_date DATE, status STRING, at TIMESTAMP, deadline TIMESTAMP, due INT, missing INT"
TIMERS = ("risk", "calm", "deadline")


def due_rows(expected: DataFrame) -> DataFrame:
    """INPUT rows that open deliveries, at their window start. ``expected``: occurrences with their ``arrival`` profile (null: unknown).

    A delivery is at risk from the first local minute after p97 and the margin on, on its local day, within its window.
    """
    day, tz = F.col("business_date"), F.col("timezone")
    minute = (F.floor(F.col("arrival.p97") + fixed.AT_RISK_MARGIN_MIN) + 1).cast("int")
    night = local_to_utc(F.date_add(day, 1), F.lit(0), tz)
    risk = F.greatest(F.col("window_start_utc"), local_to_utc(day, minute, tz))
    risk = F.when(minute.isNotNull() & (risk < night) & (risk < F.col("deadline_utc")), risk)
    return expected.filter("expected").select(
        *KEYS,
        F.lit("due").alias("kind"),
        F.col("window_start_utc").alias("at"),
        F.col("deadline_utc").alias("deadline"),
        risk.alias("risk"),
        F.when(risk.isNotNull() & (night < F.col("deadline_utc")), night).alias("calm"),
    )


def load_rows(assigned: DataFrame) -> DataFrame:
    """INPUT rows of files that have their delivery."""
    none = F.lit(None).cast("timestamp")
    return assigned.filter(F.col("slot_key").isNotNull() & (F.col("slot_key") != fixed.UNSCHEDULED_SLOT)).select(
        *KEYS, F.lit("load").alias("kind"), F.col("received_at").alias("at"), none.alias("deadline"), none.alias("risk"), none.alias("calm")
    )


def millis(t: object) -> int | None:
    return None if pd.isna(t) else int(pd.Timestamp(t).value // 1_000_000)


class DeadlineTimer(StatefulProcessor):
    """kind 'due' opens a delivery with its instants, kind 'load' is a file, others only move the clock."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("delivery", "risk BIGINT, calm BIGINT, deadline BIGINT, arrived BIGINT, status STRING")

    def _load(self) -> dict:
        names = (*TIMERS, "arrived", "status")
        return dict(zip(names, self.state.get() if self.state.exists() else [None] * len(names), strict=True))

    def _rows(self, key: tuple, deadline: int | None, changes: list[tuple[str, int, int, int]]) -> pd.DataFrame:
        n = len(changes)
        names, at, due, missing = zip(*changes, strict=True)
        status = ["PENDING" if s == "CALM" else s for s in names]
        times = {"at": pd.to_datetime(list(at), unit="ms"), "deadline": pd.to_datetime([deadline] * n, unit="ms")}
        return pd.DataFrame({**{c: [v] * n for c, v in zip(KEYS, key, strict=True)}, "status": status, **times, "due": pd.Series(due, dtype="int32"), "missing": pd.Series(missing, dtype="int32")})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        s = self._load()
        before = dict(s)
        changes: list[tuple[str, int, int, int]] = []
        for pdf in rows:
            due = pdf[pdf["kind"] == "due"]
            if len(due) and s["deadline"] is None:
                first = due.iloc[0]
                s.update({c: millis(first[c]) for c in TIMERS})
                if s["arrived"] is None:
                    changes.append(("PENDING", millis(first["at"]), 0, 0))
            came = pdf.loc[pdf["kind"] == "load", "at"]
            if len(came):
                at = millis(came.min())
                s["arrived"] = at if s["arrived"] is None else min(at, s["arrived"])
        if s["arrived"] is not None and s["deadline"] is not None:
            changes += self._came(before, s)
        if changes:
            s["status"] = changes[-1][0]
        if s == before:
            return
        self.state.update(tuple(s.values()))
        waits = s["deadline"] is not None and s["arrived"] is None
        if waits and before["deadline"] is None:
            for ms in {s[t] for t in TIMERS} - {None}:
                self.handle.registerTimer(ms)
        elif before["deadline"] is not None and before["arrived"] is None and s["arrived"] is not None:
            for ms in {s[t] for t in TIMERS} - {None}:
                self.handle.deleteTimer(ms)  # withdrawn; those that fired are gone already
        if changes:
            yield self._rows(key, s["deadline"], changes)

    def _came(self, before: dict, s: dict) -> list[tuple[str, int, int, int]]:
        """Changes because of a first file, or of one that came before what was the first."""
        status = "LATE" if s["arrived"] > s["deadline"] else "RECEIVED"
        out = []
        if before["status"] in ("RECEIVED", "LATE"):
            if s["arrived"] == before["arrived"]:
                return []
            if before["status"] == "LATE":
                out = [("REVISED", before["arrived"], 0, 1)]
            return [*out, (status, s["arrived"], 0, -1 if out else 0)]
        missed = before["status"] == "MISSING"
        if not missed:  # what the timers would have said, if the file's row came ahead of them
            fired = ["AT_RISK", "CALM", "MISSING"].index(before["status"]) + 1 if before["status"] in ("AT_RISK", "CALM") else 0
            rest = [c for c in self._due(s) if ["AT_RISK", "CALM", "MISSING"].index(c[0]) >= fired]
            out = [(t, ms, int(t == "MISSING"), int(t == "MISSING")) for t, ms in rest if ms < s["arrived"]]
            missed = bool(out) and out[-1][0] == "MISSING"
        return [*out, (status, s["arrived"], int(not missed), -int(missed))]

    @staticmethod
    def _due(s: dict) -> list[tuple[str, int]]:
        return [(status, s[t]) for t, status in (("risk", "AT_RISK"), ("calm", "CALM"), ("deadline", "MISSING")) if s[t] is not None]

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        s, ms = self._load(), expiredTimerInfo.getExpiryTimeInMs()
        now = [c for c in self._due(s) if c[1] == ms]
        if s["arrived"] is None and now:
            s["status"] = now[-1][0]
            self.state.update(tuple(s.values()))
            gone = int(s["status"] == "MISSING")
            yield self._rows(key, s["deadline"], [(*now[-1], gone, gone)])

    def close(self) -> None:
        pass


def stream_deadlines(events: DataFrame, time_mode: str = "ProcessingTime", delay: str = "0 seconds") -> DataFrame:
    """Status changes of deliveries, each at its own instant. ``events`` has the INPUT columns."""
    use_rocksdb(events.sparkSession)
    timed = events.withWatermark("at", delay) if time_mode == "EventTime" else events
    return timed.groupBy(*KEYS).transformWithStateInPandas(statefulProcessor=DeadlineTimer(), outputStructType=OUTPUT, outputMode="Append", timeMode=time_mode)


def statuses_at(changes: DataFrame, now: object) -> DataFrame:
    """(KEYS, status) at an instant. The earliest file decides; until it came, the last timer does."""
    came = F.col("status").isin("RECEIVED", "LATE")
    us = F.unix_micros("at")
    order = F.struct(came.cast("int").alias("came"), F.when(came, -us).otherwise(us).alias("us"))
    return changes.filter((F.col("at") <= F.lit(now)) & (F.col("status") != "REVISED")).groupBy(*KEYS).agg(F.max_by("status", order).alias("status"))
