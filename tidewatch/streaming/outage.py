"""Outages across senders while they happen: how many deliveries of the last 90 minutes are due, and how many are missing.

Deliveries contribute differences: one more due and missing at its deadline, one fewer missing when its file comes.
``stream_deadlines`` emits them. A batch adds its differences up per (deadline, instant), so a deadline that all senders
share is a few rows, and the signal at an instant is two sums over the deadlines of the window. Nothing is dropped for
being late: a file reported late corrects the series at its own instant.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch import fixed
from tidewatch.operators.incidents import systemic_signal
from tidewatch.streaming.store import Folders

SERIES = "deadline TIMESTAMP, effective TIMESTAMP, due BIGINT, missing BIGINT"


class OutageSeries:
    def __init__(self, spark: SparkSession, root: str, fold: int = 20) -> None:
        self.spark, self.fold = spark, fold
        self.log, self.base = Folders(spark, f"{root}/log"), Folders(spark, f"{root}/base")

    def _read(self, before: int | None = None) -> DataFrame:
        bases = [n for n in self.base.numbers() if before is None or n < before]
        logs = [n for n in self.log.numbers() if n > (bases[-1] if bases else -1) and (before is None or n < before)]
        return self.base.read(bases[-1:], SERIES).unionByName(self.log.read(logs, SERIES))

    @staticmethod
    def _sums(rows: DataFrame) -> DataFrame:
        return rows.groupBy("deadline", "effective").agg(F.sum("due").alias("due"), F.sum("missing").alias("missing")).filter("due <> 0 or missing <> 0")

    def add(self, changes: DataFrame, batch_id: int) -> None:
        """Adds a batch of ``stream_deadlines``. A batch that is run again replaces its rows."""
        logs, bases = [n for n in self.log.numbers() if n < batch_id], self.base.numbers()
        if len(logs) >= self.fold:
            self.base.write(self._sums(self._read(logs[-1] + 1)), logs[-1], "deadline")
            for n in logs:
                self.log.drop(n)
            for n in bases:
                self.base.drop(n)
        rows = changes.select("deadline", F.greatest("at", "deadline").alias("effective"), F.col("due").cast("bigint").alias("due"), F.col("missing").cast("bigint").alias("missing"))
        self.log.write(self._sums(rows.filter("deadline is not null")), batch_id)

    def signal(self, now: datetime) -> DataFrame:
        """At most one row, as ``detect_systemic`` gives it."""
        to = F.lit(now)
        since = to - F.expr(f"interval {fixed.SYSTEMIC_WINDOW_MIN} minutes")
        near = self._read().filter(F.col("deadline").between(since, to) & (F.col("effective") <= to))
        sums = near.agg(F.coalesce(F.sum("due"), F.lit(0)).alias("due"), F.coalesce(F.sum("missing"), F.lit(0)).alias("missing"))
        return sums.filter(systemic_signal(F.col("due"), F.col("missing"))).select(
            since.alias("window_start"), to.alias("window_end"), "due", "missing", (F.col("missing") / F.col("due")).alias("share")
        )


def stream_systemic(changes: DataFrame, series: OutageSeries, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Feeds the series from ``stream_deadlines``; ``series.signal(now)`` is asked by a wall-clock tick."""
    writer = changes.writeStream.foreachBatch(series.add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")).start()
